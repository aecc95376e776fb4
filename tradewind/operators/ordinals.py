"""Exact positions and running sums within groups, without a task for each group.

A window over a group sends the whole group to one task. Here rows are sorted over range partitions of group and order,
so a large group lies over many tasks; the sorted rows are checkpointed with their partition's number, as the ranges come
from sampling and would differ if they were made again. Each partition then says what its rows of each group come to; for
the groups that lie over several (fewer than there are partitions) these sums are summed up along the partitions, and
each row gets its own partition's running sum plus what lies before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums of whole numbers within each group, in this order, the row itself included. Rows in equal
    places are taken in any order, so let the order tell all rows apart. by may be empty: one group."""
    spark, keys = rows.sparkSession, [F.col(c) for c in by]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"_v_{name}": F.coalesce(value.cast("long"), F.lit(0)) for name, value in sums.items()})
    ranged = valued.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = checkpointed(ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    totals = placed.groupBy("_part", *by).agg(*(F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums))
    # As many rows as a group lies over partitions.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns({f"_b_{name}": F.sum(f"_s_{name}").over(before) for name in sums}).filter(F.col(f"_b_{next(iter(sums))}").isNotNull())
    offsets = offsets.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), *(f"_b_{name}" for name in sums))
    inside = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_i_{name}": F.sum(f"_v_{name}").over(inside) for name in sums})
    joined = summed.join(F.broadcast(offsets), (F.col("_part") == F.col("_p")) & _same(by), "left")
    return joined.select(*rows.columns, *((F.col(f"_i_{name}") + F.coalesce(f"_b_{name}", F.lit(0))).cast("long").alias(name) for name in sums))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """rows with their position (from 1) within each group in this order."""
    return running(rows, by, order, {name: F.lit(1)})


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    return out


def dealt(rows: DataFrame, by: str, order: list[Column], patterns: dict[str, list[str]], name: str = "split") -> DataFrame:
    """rows with position and what their group's pattern deals them by position, over and over; a group without a pattern
    gets null."""
    deal = F.create_map(*(x for group, pattern in patterns.items() for x in (F.lit(group), F.array(*map(F.lit, pattern)))))
    own = F.try_element_at(deal, F.col(by))
    return numbered(rows, [by], order).withColumn(name, F.get(own, F.pmod(F.col("position") - 1, F.size(own)).cast("int")))
