"""Embedding whitening: exact integer covariance by bit-sliced scatter, then the leading eigenvectors.

Components become integers. A task takes the distinct vectors in blocks; of each dimension it subtracts the block's
smallest value and packs every bit of what is left across the rows into words: one bit plane for each dimension and bit.
The sum of products of two dimensions is the sum, over pairs of their planes, of two to the bits' powers times the number
of bits that both planes have set. The shifts are undone in whole numbers. Tasks give sums only (some d^2/2 numbers, cut
into limbs that a long adds up exactly), and the driver gets one number for each pair of dimensions: n * sum(xy) - sum(x)
* sum(y), centred while still whole. Only the eigenvectors are found in doubles.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped; rows without vec_id, and
rows that repeat one, stay as they are; vectors shorter than the longest are as if filled up with zeros; an entry whose
integer doesn't fit a long counts as the long's limit, and so does such a deviation. There are as many components as
dimensions where these are fewer than asked for. Where a component has no variance (e is no more than rounding), whitened
is null, and explained too where there is no variance at all; identity_error is measured over the other components, 0 if
there are none. Equal eigenvalues leave the choice of axes open; one choice holds for all rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .vectors import LONG, floors, matrix, usable, whole

SCALE, COMPONENTS = 256, 4
#: Numbers in a block of vectors whose planes a task holds at once (8 bytes each), and bits of a limb.
BLOCK, LIMB = 1 << 22, 40
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """n vectors, their sums, the eigenvectors as columns, eigenvalues and trace of their covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def rooted(self) -> np.ndarray:
        """Square roots of the eigenvalues; nan for those that are nothing but rounding."""
        small = self.trace * self.width * np.finfo(float).eps
        return np.sqrt(np.where(self.values > small, self.values, np.nan))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly; Python's integers where longs won't do."""
        most = max(int(np.abs(x.astype(float)).max(initial=0)) + 1, *map(abs, self.sums), 1)
        if most * self.n < 1 << 60 and max(map(abs, self.sums)) < 1 << 60:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return whole(x) * self.n - np.array(self.sums, object)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z.astype(np.float64) / self.n) @ self.axes / self.rooted()


def scatter_block(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the columns of whole numbers, exactly, from the popcounts of their bit planes."""
    n, d = x.shape
    low = x.min(0)
    raised = (x - low).view(np.uint64)
    bits = [int(v).bit_length() for v in raised.max(0).tolist()]
    dims, powers, planes = [], [], []
    for i in range(d):
        for p in range(bits[i]):
            packed = np.packbits(((raised[:, i] >> np.uint64(p)) & np.uint64(1)).astype(np.uint8))
            planes.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            dims.append(i)
            powers.append(p)
    low, up = whole(low), np.zeros(d, object)
    products = np.zeros((d, d), object)
    if planes:
        planes, dims = np.array(planes), np.array(dims)
        starts = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]])
        short = 2 * max(bits) + n.bit_length() < 62
        weights = np.array([1 << p for p in powers], np.int64 if short else object)
        for at, (i, p) in enumerate(zip(dims.tolist(), powers, strict=True)):
            # All planes, those before it too: a dimension's bits then meet in both orders.
            set_bits = np.bitwise_count(planes[at] & planes).sum(1, dtype=np.int64)
            products[i, dims[starts]] += whole(np.add.reduceat(set_bits * weights, starts)) * (1 << p)
            up[i] += int(set_bits[at]) << p
    sums = up + n * low
    return sums, products + np.outer(low, up) + np.outer(up, low) + n * np.outer(low, low)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    k = 0
    while value not in (0, -1):
        yield k, value & ((1 << LIMB) - 1)
        value, k = value >> LIMB, k + 1
    if value:
        yield k, -1


def blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The vectors of column x in blocks of bounded size."""
    held, rows = [], 0
    for batch in batches:
        held.append(matrix(batch["x"], width))
        rows += len(held[-1])
        if rows * max(1, width) >= BLOCK:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def scatter(fit_list: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums and sums of products of column x, all exact."""
    small_batches(fit_list.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Row width holds the sums, row width + 1 the count.
        found = defaultdict(int)
        for x in blocks(batches, width):
            sums, products = scatter_block(x)
            found[width + 1, 0] += len(x)
            for i in range(width):
                found[width, i] += sums[i]
                for j in range(i, width):
                    found[i, j] += products[i, j]
        rows = [(i, j, k, v) for (i, j), value in found.items() for k, v in _limbs(value)]
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "k", "v"])

    total = defaultdict(int)
    for row in fit_list.select("x").mapInArrow(run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        total[row.i, row.j] += row.v << (LIMB * row.k)
    products = np.zeros((width, width), object)
    for i in range(width):
        for j in range(i, width):
            products[i, j] = products[j, i] = total[i, j]
    return total[width + 1, 0], [total[width, i] for i in range(width)], products


def fit(fit_list: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    n, sums, products = scatter(fit_list, width)
    centred = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    # Whole numbers are divided as such: each entry is the covariance, rounded once.
    covariance = np.array([[v / (n * n) for v in row] for row in centred.tolist()]).reshape(width, width)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    return Fit(n, sums, axes[:, order], values[order], float(np.trace(covariance)))


def identity_error(fit_list: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on the vectors."""
    small_batches(fit_list.sparkSession)
    live = ~np.isnan(model.rooted())
    if not live.any():
        return 0.0
    width, m = model.width, int(live.sum())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for x in blocks(batches, width):
            w = model.whitened(model.centred(x))[:, live]
            total += np.r_[w.T @ w, w.sum(0)[None]]
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), kind) for c, kind in ((i, pa.int32()), (j, pa.int32()), (total, pa.float64()))], ["i", "j", "v"])

    total = np.zeros((m + 1, m))
    for row in fit_list.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[row.i, row.j] = row.v / model.n
    return float(np.abs(total[:m] - np.outer(total[m], total[m]) - np.eye(m)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector that takes part and each of the first components; see the module for the columns."""
    spark = embeddings.sparkSession
    small_batches(spark)
    taken = usable(embeddings).select("vec_id", floors(SCALE).alias("x"))
    # Zeros at the end make no difference: with them, equal vectors are equal lists.
    width = taken.agg(F.max(F.size("x"))).first()[0] or 0
    taken = taken.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    if not width:
        return spark.createDataFrame([], OUT)
    fit_list = written(taken.select("x").distinct(), "whitening_fit")
    model = fit(fit_list, width, components)
    error, shares, m = identity_error(fit_list, model), model.values / model.trace if model.trace else None, len(model.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.centred(matrix(batch["x"], width))
            most = float(np.abs(z.astype(float)).max(initial=0))
            squares = z * z if most * most * width < 1 << 62 else whole(z) * whole(z)
            deviation = np.array([min(int(v), LONG) for v in squares.sum(1)], np.int64)
            w = model.whitened(z)
            n = len(z)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(np.repeat(np.arange(n), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * m, model.n)),
                    pa.array(np.repeat(deviation, m)),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(shares, n)) if shares is not None else pa.nulls(n * m, pa.float64()),
                    pa.array(np.full(n * m, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return taken.mapInArrow(run, OUT)
