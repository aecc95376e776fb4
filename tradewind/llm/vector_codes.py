"""Vector code compression: product codes whose rounds of assignment keep adaptive distance bounds.

Vectors of integers are cut into four parts, and each part gets the number of its codebook's nearest entry. Every part
keeps, from round to round and as a row of a written table, its entry, an upper bound of the distance to it, its b
closest other entries in order with a lower bound each, and one outer bound below all entries not in that list. When
entries move, the bounds move with them: the upper one out, the lower ones in by their own entry's way, the outer one in
by the longest way of any. A part whose upper bound stays under its first lower bound keeps its entry, and no distance is
taken. Else the distance to its own entry is taken; if it is still in doubt, as many entries of the list as have a lower
bound no higher are looked at; and only if the outer bound is no higher, all entries. b is set anew for each round, from
how far into their lists nearly all parts had to look. Bounds are doubles rounded outwards and prove entries to be
farther, never nearer: whatever they leave is decided by squared distances in whole numbers, ties to the lower index.

A round is a map over rows; tasks give the sums of each entry's parts, and the driver gets one number for each component
of the codebooks. The table of the round before is deleted.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped; rows without vec_id, and
rows that repeat one, stay as they are (among equal vec_ids the smaller vector starts a codebook first, null ones come
last); vectors shorter than the longest are as if filled up with zeros, and all up to the next multiple of four; with
fewer than 256 rows the codebooks are as much smaller; a component beyond a long counts as the long's limit, and so does
such an error. Without a column label all labels are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, written
from .vectors import LONG, floors, looked_up, matrix, usable, whole

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries listed for a part at first, and at least.
LISTED, LEAST = 32, 4
#: Parts looked at together in a task, which bounds its memory.
SLICE = 1024
#: A share by which bounds are widened, far above what rounding of square roots and sums can make up.
SLACK = 1e-9
_STATE = "vec_id long, label int, x array<long>, code binary, error array<long>, b int, upper binary, near binary, low binary, outer binary, looked int"


@dataclass
class State:
    """For each part in a row: its entry, exact squared distance, and bounds."""

    code: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray

    @classmethod
    def of(cls, n: int, b: int) -> State:
        return cls(np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, b), np.int64), np.zeros((n, b)), np.zeros(n))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances. x: rows of numbers; entries: the same for all rows, or a list of entries for each."""
    most = max(float(np.abs(x.astype(float)).max(initial=0)), float(np.abs(entries.astype(float)).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2**52:
        # Doubles hold these whole numbers, and all sums of them, exactly.
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        across = x @ entries.T if entries.ndim == 2 else np.einsum("rd,rkd->rk", x, entries)
        return ((x * x).sum(1)[:, None] - 2 * across + (entries * entries).sum(-1)).astype(np.int64)
    x, entries = whole(x), whole(entries)
    return ((x[:, None, :] - entries) ** 2).sum(-1)


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


def _ordered(d2: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Positions in order of distance, ties by index."""
    by_index = np.argsort(index, axis=1, kind="stable")
    return np.take_along_axis(by_index, np.argsort(np.take_along_axis(d2, by_index, 1), axis=1, kind="stable"), 1)


def assign(x: np.ndarray, entries: np.ndarray, state: State, moved: np.ndarray, b: int) -> tuple[State, np.ndarray]:
    """The state after entries have moved so far, with lists of b entries; and how far into its list each part had to
    look (0: not at all; one more than the list is long: at all entries)."""
    n, k = len(x), len(entries)
    b = min(b, k - 1)
    had = state.near.shape[1]
    out, looked = State.of(n, b), np.zeros(n, np.int64)
    outer = (state.outer - moved.max(initial=0)) * (1 - SLACK) - SLACK
    low = (state.low - moved[state.near]) * (1 - SLACK) - SLACK
    low = np.minimum(low, outer[:, None])
    low = np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1]
    first = low[:, 0] if had else outer
    upper = (state.upper + moved[state.code]) * (1 + SLACK) + SLACK
    code = state.code.copy()
    doubt = np.flatnonzero(~(upper < first))
    for rows in np.split(doubt, range(SLICE, len(doubt), SLICE)):
        known = state.upper[rows] < np.inf
        own = rows[known]
        upper[own] = _root(squared(x[own], entries[code[own]][:, None, :])[:, 0]) * (1 + SLACK)
    doubt = doubt[~(upper[doubt] < first[doubt])]
    # Entries beyond the list are in doubt: look at all of them, in slices.
    far = ~(upper[doubt] < outer[doubt])
    depth = (low[doubt] <= upper[doubt][:, None]).sum(1)
    looked[doubt] = np.where(far, had + 1, depth)
    keep = np.ones(n, bool)
    for rows in np.split(doubt[far], range(SLICE, int(far.sum()), SLICE)):
        d2 = squared(x[rows], entries)
        order = np.argsort(d2, axis=1, kind="stable")
        code[rows] = order[:, 0]
        root = _root(np.take_along_axis(d2, order, 1))
        upper[rows] = root[:, 0] * (1 + SLACK)
        out.near[rows], out.low[rows] = order[:, 1 : b + 1], root[:, 1 : b + 1] * (1 - SLACK)
        out.outer[rows] = root[:, b + 1] * (1 - SLACK) if k > b + 1 else np.inf
        keep[rows] = False
    # The others' nearest is their own entry or one of the first of the list: those of like depth go together.
    rest, depth = doubt[~far], depth[~far]
    order = np.argsort(depth, kind="stable")
    for at in np.split(order, range(SLICE, len(order), SLICE)):
        if len(at):
            rows, z = rest[at], int(depth[at].max())
            index = np.c_[code[rows], state.near[rows, :z]]
            d2 = squared(x[rows], entries[index])
            by = _ordered(d2, index)
            index, root = np.take_along_axis(index, by, 1), _root(np.take_along_axis(d2, by, 1))
            code[rows], upper[rows] = index[:, 0], root[:, 0] * (1 + SLACK)
            near, bounds = np.c_[index[:, 1:], state.near[rows, z:]], np.c_[root[:, 1:] * (1 - SLACK), low[rows, z:]]
            by = np.argsort(bounds, axis=1, kind="stable")
            _listed(out, rows, np.take_along_axis(near, by, 1), np.take_along_axis(bounds, by, 1), outer[rows])
            keep[rows] = False
    rows = np.flatnonzero(keep)
    _listed(out, rows, state.near[rows], low[rows], outer[rows])
    out.code, out.upper = code, upper
    return out, looked


def _listed(out: State, rows: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray) -> None:
    """Carry lists over at out's length, which is never longer: the outer bound takes in what is cut off."""
    b, had = out.near.shape[1], near.shape[1]
    out.near[rows], out.low[rows] = near[:, :b], low[:, :b]
    out.outer[rows] = np.minimum(outer, low[:, b]) if had > b else outer


def _packed(state: list[State], error: np.ndarray, looked: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each vector, the parts' states side by side. Bounds go as doubles, entries as bytes."""
    n, b = len(batch), state[0].near.shape[1]
    side = lambda get, kind: [row.tobytes() for row in np.stack([get(s).reshape(n, -1) for s in state], 1).astype(kind)]
    arrays = [
        batch["vec_id"], batch["label"], batch["x"],
        pa.array(side(lambda s: s.code, np.uint8), pa.binary()), pa.array(error.tolist(), pa.list_(pa.int64())), pa.array(np.full(n, b, np.int32)),
        pa.array(side(lambda s: s.upper, np.float64), pa.binary()), pa.array(side(lambda s: s.near, np.uint8), pa.binary()),
        pa.array(side(lambda s: s.low, np.float64), pa.binary()), pa.array(side(lambda s: s.outer, np.float64), pa.binary()),
        pa.array(looked.astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _STATE.split(", ")])


def _unpacked(batch: pa.RecordBatch) -> list[State]:
    n, b = len(batch), batch["b"][0].as_py()
    side = lambda name, kind: np.frombuffer(b"".join(batch[name].to_pylist()), kind).reshape(n, PARTS, -1)
    code, upper, near, low, outer = (side(c, k) for c, k in (("code", np.uint8), ("upper", np.float64), ("near", np.uint8), ("low", np.float64), ("outer", np.float64)))
    return [State(code[:, p, 0].astype(np.int64), upper[:, p, 0], near[:, p].reshape(n, b).astype(np.int64), low[:, p].reshape(n, b), outer[:, p, 0]) for p in range(PARTS)]


def _round(rows: DataFrame, books: list[np.ndarray], moved: list[np.ndarray], b: int, width: int) -> DataFrame:
    """Every row's state against the entries as they are now."""
    part, k = width // PARTS, len(books[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["x"], width)
            before = _unpacked(batch) if "code" in batch.schema.names else [State.of(len(x), min(b, k - 1)) for _ in range(PARTS)]
            after, error, looked = [], np.empty((len(x), PARTS), object), np.zeros(len(x), np.int64)
            for p in range(PARTS):
                own = x[:, p * part : (p + 1) * part]
                state, depth = assign(own, books[p], before[p], moved[p], b)
                after.append(state)
                error[:, p] = np.minimum(squared(own, books[p][state.code][:, None, :])[:, 0].astype(object), LONG)
                looked = np.maximum(looked, depth)
            yield _packed(after, error, looked, batch)

    return rows.mapInArrow(run, _STATE)


def _sums(rows: DataFrame, width: int) -> tuple[dict, dict]:
    """Number of parts of each (part, entry), and sums of its components, exact: high and low halves apart."""
    part = width // PARTS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, ENTRIES), np.int64)
        high, low = np.zeros((2, PARTS, ENTRIES, part), np.int64)
        for batch in batches:
            x = matrix(batch["x"], width).reshape(-1, PARTS, part)
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                count[p] += np.bincount(code[:, p], minlength=ENTRIES)
                np.add.at(high[p], code[:, p], x[:, p] >> 31)
                np.add.at(low[p], code[:, p], x[:, p] & ((1 << 31) - 1))
        p, e = np.nonzero(count)
        names = ["part", "entry", "n", "high", "low"]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(high[p, e].tolist(), pa.list_(pa.int64())), pa.array(low[p, e].tolist(), pa.list_(pa.int64()))], names)

    sums = rows.select("x", "code").mapInArrow(run, "part int, entry int, n long, high array<long>, low array<long>")
    each = sums.select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "v"))
    total = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v.high").alias("high"), F.sum("v.low").alias("low"))
    counts, found = {}, {}
    for row in total.collect():
        counts[row.part, row.entry] = row.n
        found[row.part, row.entry, row["at"]] = (row.high << 31) + row.low
    return counts, found


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows with their final codes (one byte a part) and errors of each part, and the codebooks."""
    spark = embeddings.sparkSession
    small_batches(spark)
    taken = usable(embeddings).select("vec_id", F.col("label").cast("int").alias("label"), floors(SCALE).alias("x"))
    longest = taken.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], _STATE), []
    width = PARTS * max(1, math.ceil(longest / PARTS))
    taken = taken.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    first = taken.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    part = width // PARTS
    start = np.array([r.x for r in first], np.int64).reshape(len(first), PARTS, part)
    books = [start[:, p].copy() for p in range(PARTS)]
    moved = [np.zeros(len(first)) for _ in range(PARTS)]
    rows, b = taken, LISTED
    for number in range(rounds + 1):
        before = rows
        rows = written(_round(rows, books, moved, b, width), "vector_codes")
        if number:
            dropped(before)
        if number == rounds:
            break
        counts, sums = _sums(rows, width)
        for p in range(PARTS):
            old = books[p].copy()
            for e in range(len(old)):
                if n := counts.get((p, e)):
                    books[p][e] = [sums[p, e, i] // n for i in range(part)]
            way = np.array([math.sqrt(sum((int(x) - int(y)) ** 2 for x, y in zip(*pair, strict=True))) for pair in zip(old, books[p], strict=True)])
            moved[p] = way * (1 + SLACK)
        # As long as lists that nearly all parts had to look into; those who looked at everything took new ones.
        deep = rows.agg(F.percentile_approx(F.least("looked", "b"), 0.95)).first()[0]
        b = b if number == 0 else max(LEAST, min(b, deep + 1))
    return rows, books


def codes(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row whose vector takes part."""
    rows, books = compress(embeddings, rounds)
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()
    limit = lambda c: F.least(c, F.lit(LONG)).cast("long")
    error = limit(F.aggregate("error", F.lit(0).cast("decimal(38,0)"), lambda s, e: (s + e).cast("decimal(38,0)")))
    out = rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), error.alias("error"))
    by_label = out.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), limit(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    found = looked_up(out, by_label, "label", "rows", rows.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
