"""Reviews applied to records by key, where each must meet exactly one record, with a journal of what changed.

A review that breaks a rule, or whose key meets none or several records, changes nothing and is returned with its reason.
Reviews of one record apply in their order; each journal entry has the digest of the record before and after it, so the
entries of a record form a chain. Nothing is applied in place: records, journal and refusals are three results of the
same two tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: what a review may find, and how long its note must be.
STATUSES, LEAST_NOTE = ("verified", "needs_rewrite", "rejected"), 10
#: What a review sets in a record.
SET = ("question", "reference_answer", "evidence", "expected_documents", "expected_pages", "gold_verified", "review_status", "reviewer", "review_note", "verification_note")


@dataclass
class Reviewed:
    records: DataFrame
    journal: DataFrame
    refused: DataFrame


def digest(columns: list[str]) -> Column:
    """SHA-256 of a row as canonical JSON: names in order, nulls kept, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def fault(review: DataFrame) -> Column:
    """The first rule that a review breaks, or null."""
    return (
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown_status")
        .when(_blank("reviewer"), "no_reviewer")
        .when(F.length(F.trim(F.coalesce("note", F.lit("")))) < LEAST_NOTE, "short_note")
        .when(_blank("question"), "no_question")
        .when(_blank("reference_answer"), "no_answer")
        .when(F.coalesce(F.size("evidence"), F.lit(-1)) < 1, "no_evidence")
        .when((F.col("status") == "verified") & ~F.coalesce("confirmed", F.lit(False)), "unconfirmed")
        .when(_blank("id"), "no_id")
    )


def _trimmed(values: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")


def applied(records: DataFrame, reviews: DataFrame) -> Reviewed:
    """records: id and any columns. reviews: id, at (their order), reviewer, status, confirmed, question, reference_answer,
    evidence (array), expected_documents, expected_pages (arrays of strings), note."""
    keyed = records.withColumn("_key", F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    asked = reviews.withColumn("_key", F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("reason", fault(reviews))
    # Records are counted for the keys that are asked for, so each key is one row from here on.
    met = keyed.join(asked.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_met"))
    asked = asked.join(met, "_key", "left").withColumn("_met", F.coalesce("_met", F.lit(0)))
    reason = F.coalesce("reason", F.when(F.col("_met") == 0, "no_record").when(F.col("_met") > 1, "several_records"))
    asked = asked.withColumn("reason", reason)
    good = asked.filter("reason is null")
    status, note, reviewer = F.col("status"), F.trim("note"), F.trim("reviewer")
    verified = status == "verified"
    said = F.when(verified, F.concat(F.lit("Manual PDF/page review by "), reviewer, F.lit(": "), note)).otherwise(F.concat(F.lit("Review by "), reviewer, F.lit(" ("), status, F.lit("): "), note))
    values = {
        "question": F.trim("question"), "reference_answer": F.trim("reference_answer"), "evidence": F.col("evidence"), "expected_documents": _trimmed("expected_documents"),
        "expected_pages": _trimmed("expected_pages"), "gold_verified": verified, "review_status": status, "reviewer": reviewer, "review_note": note, "verification_note": said,
    }
    changes = good.select("_key", "at", *(v.alias(f"_set_{name}") for name, v in values.items()))
    # A key with a good review has one record, so only those records meet reviews.
    touched = keyed.join(changes.select("_key").distinct(), "_key", "left_semi")
    columns = [*records.columns, *(c for c in SET if c not in records.columns)]
    steps = touched.join(changes, "_key")
    after = steps.withColumns({c: F.col(f"_set_{c}") for c in SET})
    after = after.withColumn("_after", digest(columns))
    own = Window.partitionBy("_key").orderBy("at")
    first = touched.select("_key", digest(records.columns).alias("_first"))
    chain = after.withColumns({"_before": F.lag("_after").over(own), "_last": F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("at"))) == 1}).join(first, "_key")
    journal = chain.select(F.col("_key").alias("record_id"), "at", "reviewer", "review_status", "gold_verified", F.coalesce("_before", "_first").alias("before_sha256"), F.col("_after").alias("after_sha256"))
    kept = keyed.join(changes.select("_key").distinct(), "_key", "left_anti").select(*records.columns)
    updated = chain.filter("_last").select(*columns).unionByName(kept, allowMissingColumns=True)
    refused = asked.filter("reason is not null").select("id", "at", "reason", F.col("_met").alias("records"))
    return Reviewed(updated, journal, refused)


def replaced(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """The records after all reviews; an error if any of them is refused, before anything is returned."""
    result = applied(records, reviews)
    bad = result.refused.orderBy("at").first()
    if bad is not None:
        raise ValueError(f"review of {bad.id!r} refused: {bad.reason}, {bad.records} records")
    return result.records
