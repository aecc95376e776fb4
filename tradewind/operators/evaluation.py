"""Evaluation: ranking metrics, classification metrics, their summaries, and planner metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(results: DataFrame, expected: DataFrame, cut: int = 5, deep: int = 10) -> DataFrame:
    """query_id, hit_at_1, hit_at_5, recall_at_5, mrr_at_10, ndcg_at_5 of every query with expected documents.

    results: query_id, rank, doc_id. expected: query_id, doc_id. Only a document's first place counts."""
    first = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
    places = first.withColumn("place", rank)
    e = expected.select("query_id", "doc_id").distinct()
    n = e.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = places.join(e, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(
        F.min("place").alias("best"), F.count_if(F.col("place") <= cut).alias("found"), F.sum(F.when(F.col("place") <= cut, (1.0 / F.log2(F.col("place") + 1.0)).cast("decimal(18,12)"))).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(cut)).cast("int")), F.lit(0).cast("decimal(18,12)"), lambda acc, i: (acc + (1.0 / F.log2(i + 1.0)).cast("decimal(18,12)")).cast("decimal(18,12)"))
    m = n.join(hits, "query_id", "left")
    return m.select(
        "query_id", F.coalesce((F.col("best") == 1).cast("long"), F.lit(0)).alias("hit_at_1"), F.coalesce((F.col("best") <= cut).cast("long"), F.lit(0)).alias("hit_at_5"),
        (F.coalesce("found", F.lit(0)) / F.col("n").cast("double")).alias("recall_at_5"), F.coalesce(F.when(F.col("best") <= deep, 1.0 / F.col("best")), F.lit(0.0)).alias("mrr_at_10"),
        (F.coalesce("gain", F.lit(0)).cast("double") / ideal.cast("double")).alias("ndcg_at_5"),
    )


def summary(rows: DataFrame, measure: str, *levels: str) -> DataFrame:
    """level, value, items, mean, median, p95 (linear) and p95_nearest of a measure: overall and by each level, in one pass."""
    values = F.expr("stack({}, {})".format(1 + len(levels), ", ".join(["'overall', 'all'", *(f"'{c}', cast({c} as string)" for c in levels)])))
    each = rows.select(F.col(measure).cast("double").alias("m"), *levels).select("m", values.alias("level", "value")).filter("value is not null and value <> ''")
    return each.groupBy("level", "value").agg(
        F.count("m").alias("items"), (F.sum(F.col("m").cast("decimal(28,9)")).cast("double") / F.count("m")).alias("mean"), F.percentile("m", F.lit(0.5)).alias("median"),
        F.percentile("m", F.lit(0.95)).alias("p95"), F.expr("percentile_disc(0.95) within group (order by m)").alias("p95_nearest"),
    )


def safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """expected, predicted, n for every pair of labels, zero cells too. rows: expected, predicted."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "expected string, predicted string")
    return grid.join(rows.groupBy("expected", "predicted").agg(F.count("*").alias("c")), ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("c", F.lit(0)).alias("n"))


def classification(rows: DataFrame, labels: list[str]) -> DataFrame:
    """label, support, precision, recall, f1; and the accuracy over all rows."""
    c = confusion(rows, labels)
    sums = lambda side: c.groupBy(F.col(side).alias("label")).agg(F.sum("n").alias(f"{side}_n"))
    right = c.filter("expected = predicted").select(F.col("expected").alias("label"), F.col("n").alias("right"))
    all_of = rows.agg(safe(F.count_if(F.col("expected") == F.col("predicted")), F.count("*")).alias("accuracy"))
    m = right.join(sums("expected"), "label").join(sums("predicted"), "label").crossJoin(F.broadcast(all_of))
    p, r = safe(F.col("right"), F.col("predicted_n")), safe(F.col("right"), F.col("expected_n"))
    return m.select("label", F.col("expected_n").alias("support"), p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"), "accuracy")


def tool_metrics(rows: DataFrame) -> DataFrame:
    """id, same_sequence, precision, recall, f1 of predicted tools against expected ones; two empty lists agree wholly."""
    e, p = F.array_distinct("expected_tools"), F.array_distinct("predicted_tools")
    common = F.size(F.array_intersect(e, p)).cast("double")
    none = (F.size(e) == 0) & (F.size(p) == 0)
    precision, recall = F.when(none, 1.0).otherwise(safe(common, F.size(p))), F.when(none, 1.0).otherwise(safe(common, F.size(e)))
    return rows.select("id", (F.col("expected_tools") == F.col("predicted_tools")).alias("same_sequence"), precision.alias("precision"), recall.alias("recall"), safe(2 * precision * recall, precision + recall).alias("f1"))
