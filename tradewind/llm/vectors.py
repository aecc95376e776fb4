"""Rows of vectors that take part, and joins that no hot key holds up: shared by the operators on `embeddings`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is hot: there are fewer hot keys than this.
HOT = 200
LONG = (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """vec_id long, embedding, label (null if there is none): rows whose vector is there and holds finite numbers only.
    Other columns are left out."""
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int").alias("label")
    taken = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label)
    return taken.filter(finite(F.col("embedding")))


def finite(vector: Column) -> Column:
    """True for vectors of finite numbers; false for null ones."""
    there = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & there, F.lit(False))


def floors(scale: int) -> Column:
    """floor(scale * component) as longs; beyond a long, its limit."""
    # A double of 2^63 or more has no long; Spark's floor gives the limit then, and a zero never keeps a sign.
    return F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The lists of an Arrow array as rows, filled up with zeros."""
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] if len(at) > 1 else np.empty(0)
    sizes = np.diff(at)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], sizes)] = flat
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """Integers of any size, one Python object each."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def looked_up(rows: DataFrame, values: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with values on a key (null equals null), where values has one row a key and, in count, its number of
    rows. Hot keys go out with a broadcast of fewer than HOT rows; the rest is left to a shuffle, or to what the
    optimiser takes for it. No order is kept."""
    values = values.withColumnRenamed(key, "_key")
    hot = F.col(count) * HOT > total
    often, rare = values.filter(hot), values.filter(~hot)
    on = F.col(key).eqNullSafe(F.col("_key"))
    first = rows.join(F.broadcast(often), on)
    left = rows.join(F.broadcast(often), on, "left_anti")
    return first.unionByName(left.join(rare, on, how)).drop("_key")
