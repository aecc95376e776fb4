"""Substring dedup by relative Lempel-Ziv parsing against the whole corpus.

The reference is every document with a smaller doc_id. It is indexed in blocks: the text itself says where a block
begins (one place in BLOCK on average, by the words there, and after MOST places), and a block's key hashes all words
of the windows that begin in it. Equal stretches of two documents so fall into equal blocks, wherever they stand.

Parsing is greedy, longest parts first. A document's blocks are looked up by key: where an earlier document has a
block, all windows that begin in it are repeated, and a factor runs on over neighbouring blocks. What is left are the
windows at the boundaries of factors and in new text. These are looked up one by one, but only where it can help: in
each run of `window` words, the smallest hash of a short gram is the anchor (so equal windows have equal anchors),
and windows are looked up whose anchor gram stands in the left-over text of two documents. That is enough: the first
document to have a window can't have it in a block that an earlier one has too. Factors of at least one whole window
become the spans to remove; since every window is looked up, also those across the boundary of two factors are.

Keys are 96 bits wide, over 64-bit word hashes. Before keys are shuffled, a task resolves those that its own rows
repeat, so that a passage in very many documents gives a task's part of the shuffle one row.

Defined results: null, empty and blank texts have no words; rows that repeat a doc_id don't remove each other's
words (no smaller id); rows without doc_id are neither reference nor parsed; other columns are left out; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, gram_hashes, mix64, ranges, small_batches
from .common import words as words_of

WINDOW = 13
GRAM = 5
#: Places to a block, on average, and at most.
BLOCK, MOST = 16, 64
#: Rows that a task resolves among themselves at once.
ROWS = 1 << 20
SECOND = np.uint64(0x51ED270B7F4A7C15)
_PLACE_BITS = np.uint64(28)


class Parse:
    """A batch of texts as words, window starts and blocks of these. Places count through the whole batch."""

    def __init__(self, texts: pa.Array, window: int):
        self.window = window
        self.h, self.starts, self.first, self.raw = words_of(texts)
        self.n = np.diff(self.first)
        windows = np.maximum(self.n - window + 1, 0)
        self.windows = ranges(self.first[:-1], windows)
        cut = np.zeros(len(self.h) + 1, bool)
        pairs = mix64(self.h[:-1] * np.uint64(3) + self.h[1:]) if len(self.h) else self.h
        at = self.windows[self.windows < len(pairs)]
        cut[at] = pairs[at] % np.uint64(BLOCK) == 0
        cut[self.first[:-1][windows > 0]] = True
        blocks = np.flatnonzero(cut)
        ends = np.minimum(np.r_[blocks[1:], len(self.h)], (self.first[:-1] + windows)[self.doc(blocks)])
        pieces = -(-(ends - blocks) // MOST)
        self.blocks = np.repeat(blocks, pieces) + MOST * ranges(np.zeros(len(pieces), np.int64), pieces)
        self.lengths = np.minimum(np.repeat(ends, pieces) - self.blocks, MOST)

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def block_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all words of the windows of each block."""
        n = self.lengths + self.window - 1
        if not len(n):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        where, heads = ranges(self.blocks, n), np.cumsum(n) - n
        place = ranges(np.zeros(len(n), np.int64), n)
        powers = [np.cumprod(np.full(MOST + self.window, x, np.uint64), dtype=np.uint64) for x in (0xD1342543DE82EF95, 0x9E3779B97F4A7C15)]
        one, two = (np.add.reduceat(h[where] * p[place], heads) for h, p in zip((self.h, mix64(self.h ^ SECOND)), powers, strict=True))
        size = n.astype(np.uint64)
        return mix64(one + size), mix64(two + size)

    def flags(self, lists: pa.Array) -> np.ndarray:
        """Which places a column of lists names, by their place in the document."""
        out = np.zeros(len(self.h) + 1, bool)
        counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
        out[lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(self.first[:-1], counts)] = True
        return out

    def in_blocks(self, lists: pa.Array) -> np.ndarray:
        """Window starts that lie in the listed blocks, as flags."""
        out = np.zeros(len(self.h) + 1, bool)
        known = self.flags(lists)[self.blocks]
        out[ranges(self.blocks[known], self.lengths[known])] = True
        return out

    def left(self, lists: pa.Array) -> np.ndarray:
        """Window starts that lie in no listed block."""
        return self.windows[~self.in_blocks(lists)[self.windows]]

    def anchors(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all grams, and for each window start the place of its anchor gram."""
        g = gram_hashes(self.h, gram)
        least = (g >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(g), dtype=np.uint64)
        size, wide = 1, self.window - gram + 1
        while size < wide:
            step = min(size, wide - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        return g, (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows with doc_id; and `row`, which tells rows of one doc_id apart, where ids repeat."""
    rows = documents(docs).filter("doc_id is not null")
    unique = rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return rows if unique else rows.withColumn("row", F.xxhash64("doc_id", "text"))


def keys_of(rows: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "row") if c in rows.columns]


def resolved(key: np.ndarray, more: np.ndarray, doc: np.ndarray, at: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are known to share their key with a row of an earlier document (both: of another document), and the
    keys to shuffle by: a known row's no longer matters and is spread, but for one row of each key."""
    order = np.argsort(key, kind="stable")
    k, d, m = key[order], doc[order], more[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    counts = np.diff(np.r_[heads, len(k)])
    least, most = (np.repeat(f.reduceat(d, heads), counts) for f in (np.minimum, np.maximum))
    same = np.repeat(np.minimum.reduceat(m, heads) == np.maximum.reduceat(m, heads), counts)
    known = same & ((least < most) if both else (d > least))
    spread = known.copy()
    if both:
        # The first row of the least document stands for the key in other tasks.
        is_least = np.flatnonzero(d == least)
        spread[is_least[np.r_[True, k[is_least][1:] != k[is_least][:-1]]]] = False
    k = np.where(spread, mix64(d.view(np.uint64) + mix64(at[order].astype(np.uint64))), k)
    out_known, out_key = np.empty(len(key), bool), np.empty(len(key), np.uint64)
    out_known[order], out_key[order] = known, k
    return out_known, out_key


def _looked_up(rows: DataFrame, find, *columns: str, both: bool = False) -> DataFrame:
    """The keys, places: of what find gives for a batch of texts (key, more, place), the places of those that an earlier
    document has too (both: that two documents have)."""
    keys = keys_of(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            key, more, at, *ids = (np.concatenate(c) for c in zip(*held, strict=True))
            known, key = resolved(key, more, ids[0], at, both)
            arrays = [pa.array(key.view(np.int64)), pa.array((more >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array((2 * at + known).astype(np.int64)), *map(pa.array, ids)]
            return pa.RecordBatch.from_arrays(arrays, ["key", "more", "at", *keys])

        for b in batches:
            parse, key, more, at = find(b)
            doc = parse.doc(at)
            held.append((key, more, at - parse.first[doc], *(b[k].to_numpy(zero_copy_only=False).astype(np.int64)[doc] for k in keys)))
            if sum(len(h[0]) for h in held) >= ROWS:
                yield flush()
                held = []
        if held:
            yield flush()

    found = rows.select(*keys, "text", *columns).mapInArrow(run, ", ".join(["key long, more int, at long", *(f"{k} long" for k in keys)]))
    same = Window.partitionBy("key") if both else Window.partitionBy("key", "more")
    found = found.withColumn("low", F.min("doc_id").over(same))
    if both:
        found = found.withColumn("high", F.max("doc_id").over(same))
    found = found.filter(f"at % 2 = 1 or low < {'high' if both else 'doc_id'}")
    return found.groupBy(*keys).agg(F.collect_list(F.shiftright("at", 1).cast("int")).alias("places"))


def repeated(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """rows with blocks and starts: the blocks that an earlier document has too, and the windows, elsewhere, of which
    that holds. Places are those of the first word; null where there are none."""
    keys = keys_of(rows)

    def all_blocks(b: pa.RecordBatch) -> tuple:
        parse = Parse(b["text"], window)
        return parse, *parse.block_keys(), parse.blocks

    def left_anchors(b: pa.RecordBatch) -> tuple:
        parse = Parse(b["text"], window)
        g, anchor = parse.anchors(gram)
        at = anchor[parse.left(b["blocks"])]
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        return parse, g[at], g[at], at

    def left_windows(b: pa.RecordBatch) -> tuple:
        parse = Parse(b["text"], window)
        _, anchor = parse.anchors(gram)
        at = parse.left(b["blocks"])
        at = at[parse.flags(b["shared"])[anchor[at]]]
        return parse, gram_hashes(parse.h, window)[at], gram_hashes(mix64(parse.h ^ SECOND), window)[at], at

    def joined(left: DataFrame, right: DataFrame, name: str, how: str = "left") -> DataFrame:
        # The places of a document are far smaller than its text: texts are streamed, not sorted.
        return left.join(right.withColumnRenamed("places", name).hint("shuffle_hash"), keys, how)

    with_blocks = joined(rows, _looked_up(rows, all_blocks), "blocks")
    shared = _looked_up(with_blocks, left_anchors, "blocks", both=True)
    starts = _looked_up(joined(with_blocks, shared, "shared", "inner"), left_windows, "blocks", "shared")
    return joined(with_blocks, starts, "starts")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that no repeated window covers, joined by one space."""
    return _cut(docs, window, gram, "kept")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return _cut(docs, window, gram, "kept_sha256")


def covered(starts: np.ndarray, window: int) -> np.ndarray:
    """Which words a factor covers, from flags of the starts of repeated windows."""
    so_far = np.cumsum(starts, dtype=np.int64)
    so_far[window:] -= so_far[:-window].copy()
    return so_far > 0


def _cut(docs: DataFrame, window: int, gram: int, result: str) -> DataFrame:
    small_batches(docs.sparkSession)
    none = F.lit(None).cast("array<int>")
    parsed = repeated(keyed(docs), window, gram).select("doc_id", "text", "blocks", "starts")
    rest = documents(docs).filter("doc_id is null").select("doc_id", "text", none.alias("blocks"), none.alias("starts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parse = Parse(b["text"], window)
            gone = covered(parse.in_blocks(b["blocks"]) | parse.flags(b["starts"]), window)[:-1]
            # Words with one byte after each, as bytes; that byte becomes a space.
            sizes = np.add.reduceat((~SPACE[parse.raw]).astype(np.int64), parse.starts) if len(parse.starts) else np.empty(0, np.int64)
            sizes = (sizes + 1)[~gone]
            out = np.append(parse.raw, np.uint8(32))[ranges(parse.starts[~gone], sizes)]
            ends = np.cumsum(sizes)
            out[ends - 1] = 32
            n_kept = np.r_[0, np.cumsum(~gone)][parse.first]
            edges = np.r_[0, ends][n_kept]
            kept = []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                text = out[s : max(s, e - 1)].tobytes()
                kept.append(text.decode() if result == "kept" else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(parse.n, pa.int64()), pa.array(parse.n - np.diff(n_kept), pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", result])

    return parsed.unionByName(rest).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {result} string")
