"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors of integers are indexed in blocks, once. A posting is a component of a vector; its impact is its size,
quantised to its number of bits. A segment holds the postings of one impact and one dimension: the rows of a block
whose component there has that size. A search takes the segments from the highest impact down, and a segment touches
its own rows and its own dimension only. After each impact, what a vector can still add to a score is at most the
length of its components not yet seen (kept in the index) times the query's length. Vectors whose sum and bound can't
reach the k-th best score are dropped, on that proof only; when few are left, or no segment is, these are scored
exactly from their whole vectors.

Queries go out in batches of bounded size, one broadcast at a time; each batch's results are written before the next
goes out. Each task returns its k best for each query, and a window takes the k best of all.

Defined results: vectors that are null, or hold null or non-finite components (also once scaled), take no part, nor do
rows without vec_id; rows that repeat a vec_id count as one, with the smallest vector; shorter vectors are as if filled
up with zeros; ties go to the smaller vec_id; fewer than k candidates are all returned; other columns are left out.
Components and scores are exact integers of any size; a score beyond a long is returned as its limit, and those tie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Vectors in a block (numbers of 16 bits tell them apart), queries scored together in a task, and queries in one
#: broadcast on average (some 10 to 20 MB).
BLOCK, TOGETHER, BATCH = 8192, 256, 16_384
#: Share of a block's vectors that may be left for scoring before the last segment.
FEW = 0.02
#: Sizes from which sums of doubles are no proof and all is scored exactly.
LARGE = 2.0**50
_LONG = (-(1 << 63), (1 << 63) - 1)
INDEX = "ids binary, width int, kind string, vectors binary, impacts array<int>, dims array<int>, counts array<int>, rows binary, tails binary"


def quantised(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v array<double>: floor(scale * x) of every component of the vectors that take part."""
    x = F.col("embedding")
    scaled = F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double"))
    kept = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    kept = kept.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # A double of 2^53 or more is a whole number; below, its floor fits a long.
    v = F.transform("v", lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))
    return kept.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and q, pair by pair; Python's integers where doubles might not do."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= 2**53:
        whole = np.vectorize(int, otypes=[object])
        return (whole(x) * whole(q)).sum(1)
    return np.einsum("ij,ij->i", x, q).astype(np.int64)


class Segments:
    """A block's index: segments of one impact and dimension, the highest impact first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        bits = np.frexp(np.abs(x))[1]
        bits[x == 0] = 0
        row, dim = np.nonzero(x)
        impact = bits[row, dim]
        order = np.lexsort((row, dim, -impact))
        self.rows, dim, impact = row[order].astype(np.uint16), dim[order], impact[order]
        heads = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (impact[1:] != impact[:-1])]) if len(dim) else np.empty(0, np.int64)
        self.impacts, self.dims, self.counts = impact[heads], dim[heads], np.diff(np.r_[heads, len(dim)])
        #: For each impact, the length of what comes later of each vector.
        size = x if np.abs(x).max(initial=0) < LARGE else np.zeros_like(x)
        self.tails = np.array([np.sqrt((np.where(bits < b, size, 0) ** 2).sum(1)) for b in self.levels()]).reshape(-1, len(ids))

    def levels(self) -> list[int]:
        return sorted(set(self.impacts.tolist()), reverse=True)

    def packed(self) -> dict:
        most = np.abs(self.x).max(initial=0)
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
        # Rounded up, so that a tail stays a bound.
        tails = np.nextafter(self.tails.astype("<f4"), np.float32(np.inf))
        return {"ids": self.ids.astype("<i8").tobytes(), "width": self.x.shape[1], "kind": kind, "vectors": self.x.astype(kind).tobytes(), "impacts": self.impacts.tolist(), "dims": self.dims.tolist(), "counts": self.counts.tolist(), "rows": self.rows.tobytes(), "tails": tails.tobytes()}

    @classmethod
    def unpacked(cls, row: dict) -> Segments:
        out = cls.__new__(cls)
        out.ids = np.frombuffer(row["ids"], "<i8")
        out.x = np.frombuffer(row["vectors"], row["kind"]).reshape(len(out.ids), row["width"]).astype(np.float64)
        out.impacts, out.dims, out.counts = (np.array(row[c], np.int64) for c in ("impacts", "dims", "counts"))
        out.rows = np.frombuffer(row["rows"], np.uint16)
        out.tails = np.frombuffer(row["tails"], "<f4").reshape(-1, len(out.ids)).astype(np.float64)
        return out

    def possible(self, q: np.ndarray, own: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(vector, query) pairs that may be among a query's k best, and how many postings were taken for each query.
        known: a score that k vectors are known to reach."""
        mine = self.ids[:, None] == own[None, :]
        alive = ~mine
        most = max(float(np.abs(self.x).max(initial=0)), float(np.abs(q).max(initial=0)))
        if most >= LARGE:
            return *np.nonzero(alive), 0
        qt, length = np.ascontiguousarray(q.T), np.sqrt((q**2).sum(1))
        total = np.zeros((len(self.ids), q.shape[0]))
        # Sums of doubles may be off by a little; the proof leaves room for that.
        slack = 1e-9 * most * most * max(1, q.shape[1])
        at = seg = 0
        for level, tail in zip(self.levels(), self.tails, strict=True):
            while seg < len(self.impacts) and self.impacts[seg] == level:
                rows, dim = self.rows[at : at + self.counts[seg]], self.dims[seg]
                total[rows] += self.x[rows, dim][:, None] * qt[dim]
                at, seg = at + len(rows), seg + 1
            rest = tail[:, None] * length[None, :] + slack
            floor = known
            unknown = np.isneginf(known)
            if len(self.ids) > k and unknown.any():
                low = np.where(mine, -np.inf, total - rest)[:, unknown]
                floor = known.copy()
                floor[unknown] = np.partition(low, len(low) - k, axis=0)[len(low) - k]
            alive &= total + rest >= floor[None, :]
            if alive.sum() <= FEW * alive.size:
                break
        return *np.nonzero(alive), at


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def search_block(block: Segments, q_ids: np.ndarray, q: np.ndarray, k: int, state: list) -> int:
    """Bring each query's (ids, scores) in `state` up to date with a block; returns the multiplications that took."""
    work, wide = 0, max(block.x.shape[1], q.shape[1])
    # Dimensions that one side lacks are zeros there.
    q, x = q[:, : block.x.shape[1]], block.x
    if q.shape[1] < x.shape[1]:
        q = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
    for at in range(0, len(q_ids), TOGETHER):
        some = slice(at, at + TOGETHER)
        known = np.array([float(s[1].min()) if len(s[0]) >= k else -np.inf for s in state[some]])
        rows, cols, taken = block.possible(q[some], q_ids[some], k, known)
        work += taken * len(known) + len(rows) * wide
        order = np.argsort(cols, kind="stable")
        rows, ends = rows[order], np.searchsorted(cols[order], np.arange(len(known) + 1))
        for c in range(len(known)):
            # A query's candidates at a time: where nothing can be dropped, these are a block's vectors.
            mine = rows[ends[c] : ends[c + 1]]
            scores = _exact(x[mine], np.broadcast_to(q[at + c], (len(mine), x.shape[1])))
            ids, old = state[at + c]
            ids, all_scores = np.r_[ids, block.ids[mine]], np.concatenate([old, scores])
            top = best(ids, all_scores, k)
            state[at + c] = (ids[top], all_scores[top])
    return work


def index(vectors: DataFrame) -> DataFrame:
    """A row for each block of vectors (vec_id, v): its vectors and segments."""
    small_batches(vectors.sparkSession)
    kinds = {"ids": pa.binary(), "width": pa.int32(), "kind": pa.string(), "vectors": pa.binary(), "impacts": pa.list_(pa.int32()), "dims": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "rows": pa.binary(), "tails": pa.binary()}

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        lists: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            whole = Segments(np.concatenate(ids), matrix(lists, max(map(len, lists))))
            ids.clear()
            lists.clear()
            return pa.RecordBatch.from_pylist([whole.packed()], schema=pa.schema(kinds))

        for b in parts:
            v = b["v"]
            offsets, flat = v.offsets.to_numpy(), v.values.to_numpy()
            for at in range(0, b.num_rows, BLOCK):
                some = range(at, min(b.num_rows, at + BLOCK))
                if len(lists) + len(some) > BLOCK:
                    yield block()
                ids.append(b["vec_id"].to_numpy()[some.start : some.stop])
                lists += [flat[offsets[i] : offsets[i + 1]] for i in some]
        if lists:
            yield block()

    return vectors.select("vec_id", "v").mapInArrow(run, INDEX)


def _found(blocks: DataFrame, sent, k: int) -> DataFrame:
    """query_id, vec_id, score: of each task's blocks the k best for each query of a broadcast batch."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_lists = sent.value
        q = matrix(q_lists, max(map(len, q_lists), default=0))
        state: list = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
        for b in parts:
            for i in range(b.num_rows):
                search_block(Segments.unpacked(b.slice(i, 1).to_pylist()[0]), q_ids, q, k, state)
        counts = [len(s[0]) for s in state]
        if sum(counts):
            scores = [min(max(int(x), _LONG[0]), _LONG[1]) for s in state for x in s[1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, counts)), pa.array(np.concatenate([s[0] for s in state])), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. vectors, queries: vec_id, v."""
    spark = vectors.sparkSession
    blocks = written(index(vectors), "index")
    batches = max(1, -(-queries.count() // BATCH))
    queries = queries.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = None
    for n in range(batches):
        rows = queries.filter(F.col("batch") == n).select("vec_id", "v").collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), [np.array(r[1], np.float64) for r in rows]))
        part = _found(blocks, sent, k).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if batches == 1:
            return part
        # Written, so that the driver and the executors hold one batch of queries at a time.
        part = written(part, "found")
        sent.destroy()
        out = part if out is None else out.union(part)
    return out


def search(rows: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best of all rows for each row whose vec_id is divisible by `every`."""
    vectors = written(quantised(rows, scale), "vectors")
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
