"""Audits of a folder's files by their names and digests: groups, what is missing, what each file is, and what to do.

Files are rows (path, and sha256 where contents count), as sources.shelf.files lists them; nothing is moved. Rules are
lists in order, so another folder takes other rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, squeeze
from ..functions.wording import stem


def name_form(text: Column) -> Column:
    """What names are matched by: folded letters and digits."""
    return squeeze(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def _plain(words: tuple[str, ...], names: DataFrame) -> list[str]:
    return list(names.sparkSession.range(1).select(*(name_form(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words))).first()) if words else []


def groups(files: DataFrame) -> DataFrame:
    """group, files: how many files each top folder holds. files: path, from the folder on."""
    return files.groupBy(F.regexp_extract("path", "^([^/]+)/", 1).alias("group")).agg(F.count(F.lit(1)).alias("files"))


def missing(files: DataFrame, required: DataFrame) -> DataFrame:
    """name of the required files (name) that aren't there, wherever they may lie."""
    there = files.select(F.lower(F.regexp_extract("path", "([^/]*)$", 1)).alias("_name")).distinct()
    return required.join(there, F.lower("name") == F.col("_name"), "left_anti").select("name")


def classified(files: DataFrame, drafts: tuple[str, ...], rules: list[tuple[tuple[str, ...], str]], standard: str, review: str = r"^[a-z0-9]{15,}$") -> DataFrame:
    """path, status, target. A name that begins with `standard` is kept as it is; one with a draft's word is left out; one
    that matches `review` (its form without spaces) is looked at by hand; else the first rule with one of its words names
    it; what no rule names is unrecognised. A target that is there already, or that several files would get, is a
    duplicate where the digests are equal, else a conflict."""
    form = name_form(stem(F.col("path")))
    holds = lambda words: reduce(Column.__or__, (F.contains(F.col("form"), F.lit(w)) for w in _plain(words, files)), F.lit(False))
    rows = files.withColumns({"form": form, "name": F.lower(F.regexp_extract("path", "([^/]*)$", 1))})
    target = reduce(lambda chain, rule: chain.when(holds(rule[0]), rule[1]), rules, F)
    kind = F.when(F.col("name").startswith(standard), "standard").when(holds(drafts), "excluded_draft").when(F.regexp_replace("form", " ", "").rlike(review), "manual_review")
    rows = rows.withColumn("kind", kind).withColumn("target", F.when(F.col("kind").isNull(), target.otherwise(F.lit(None))))
    # Who has a target's name already, or gets it first (by path).
    owners = rows.filter("kind = 'standard'").select(F.col("name").alias("target"), F.lit(0).alias("late"), "path", "sha256").unionByName(rows.filter("target is not null").select("target", F.lit(1).alias("late"), "path", "sha256"))
    first = owners.groupBy("target").agg(F.min(F.struct("late", "path", "sha256")).alias("o")).select("target", F.col("o.path").alias("owner"), F.col("o.sha256").alias("owner_sha256"))
    own = F.when(F.col("owner") == F.col("path"), "renamed").when(F.col("owner_sha256") == F.col("sha256"), "duplicate").otherwise("conflict")
    found = rows.join(first, "target", "left")
    return found.select("path", F.coalesce("kind", F.when(F.col("target").isNull(), "unrecognized").otherwise(own)).alias("status"), "target")


def double_extensions(files: DataFrame, extension: str = ".pdf") -> DataFrame:
    """path, target, status of names with an extension twice: fixed, or a duplicate or conflict where the target is there."""
    twice = files.filter(F.lower("path").endswith(extension * 2)).withColumn("target", F.expr(f"left(path, length(path) - {len(extension)})"))
    there = files.select(F.col("path").alias("target"), F.col("sha256").alias("there"))
    status = F.when(F.col("there").isNull(), "fixed_double_extension").when(F.col("there") == F.col("sha256"), "duplicate_double_extension").otherwise("double_extension_conflict")
    return twice.join(there, "target", "left").select("path", "target", status.alias("status"))
