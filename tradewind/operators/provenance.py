"""Where a result comes from: digests of tables that don't depend on the order of rows, gates before a table is locked,
and the manifest that says so.

A row's digest is that of its canonical JSON, cut into four numbers; a table's digest is made of their sums and the number
of rows. Sums come from each task's own, so a table of any size is read once and nothing is sorted; equal tables have
equal digests however they lie in files, and a changed, lost or repeated row changes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import digest

#: Fixed: the parts that a benchmark must have, and ids named in an error.
SPLITS, EXAMPLES = ("challenge", "dev", "test"), 10
_PARTS = 4


def _part(sha: Column, n: int) -> Column:
    """The n-th 64 bits of a hexadecimal digest as a whole number."""
    return F.conv(F.substring(sha, 1 + 16 * n, 16), 16, 10).cast("decimal(20,0)")


def table_digest(columns: list[str]) -> Column:
    """An aggregate: the digest of a table of these columns."""
    row = digest(columns)
    sums = [F.pmod(F.coalesce(F.sum(_part(row, n).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("string") for n in range(_PARTS)]
    return F.sha2(F.concat_ws(",", F.lit(",".join(sorted(columns))), F.count(F.lit(1)).cast("string"), *sums), 256)


def gates(items: DataFrame) -> DataFrame:
    """gate, passed, found, examples: what must hold before a benchmark is locked. items: id, split, gold_verified, flags
    (array). Two passes: one counts, one finds the smallest few ids of those that break a rule."""
    split = F.lower(F.trim(F.coalesce("split", F.lit(""))))
    verified = F.coalesce("gold_verified", F.lit(False))
    flagged = F.coalesce(F.size("flags"), F.lit(0)) > 0
    counts = items.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(split == "test").alias("test"), F.array_sort(F.collect_set(F.when(split.isin(*SPLITS), split))).alias("splits"),
        F.count_if(~verified).alias("unverified"), F.count_if(flagged).alias("flagged"), table_digest(items.columns).alias("sha256"),
    )
    few = lambda broken: items.filter(broken).select(F.col("id").cast("string").alias("id")).orderBy("id").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("x"))
    both = counts.crossJoin(F.broadcast(few(~verified).withColumnRenamed("x", "u"))).crossJoin(F.broadcast(few(flagged).withColumnRenamed("x", "f")))
    missing = F.array_except(F.array(*map(F.lit, SPLITS)), "splits")
    gate = lambda name, passed, found, examples: F.struct(F.lit(name).alias("gate"), passed.alias("passed"), found.cast("long").alias("found"), examples.alias("examples"))
    none = F.lit("")
    rows = F.array(
        gate("not_empty", F.col("items") > 0, F.col("items"), none), gate("splits_present", F.size(missing) == 0, F.size(missing), F.array_join(missing, ",")),
        gate("test_has_items", F.col("test") > 0, F.col("test"), none), gate("all_verified", F.col("unverified") == 0, F.col("unverified"), F.col("u")),
        gate("no_flags", F.col("flagged") == 0, F.col("flagged"), F.col("f")),
    )
    return both.select("sha256", F.explode(rows).alias("g")).select("g.*", "sha256")


def manifest(tables: dict[str, DataFrame], name: str, configuration: dict[str, str], status: str) -> DataFrame:
    """table, rows, sha256, and what was run and how: one row for each table, each read once. Times and revisions are the
    caller's to put into the configuration."""
    settings = F.to_json(F.create_map(*(F.lit(x) for pair in sorted(configuration.items()) for x in pair))) if configuration else F.lit("{}")
    out = None
    for table, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), table_digest(df.columns).alias("sha256")).select(F.lit(table).alias("table"), "rows", "sha256")
        out = row if out is None else out.unionByName(row)
    return out.withColumns({"evaluation": F.lit(name), "configuration": settings, "status": F.lit(status)})
