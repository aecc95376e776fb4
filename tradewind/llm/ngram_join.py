"""N-gram Jaccard join by a forest of signature trees.

A document's set holds the distinct runs of k words (lower-cased in A-Z; a shorter text is one run). Equal texts
are one class; classes are joined, documents follow their class. Runs and texts are told apart by 64-bit hashes.

Routing to trees. Two sets of a and b members with Jaccard similarity of at least t differ in at most
(1-t)/(1+t)(a+b) members. Each set is dealt by hash into more parts than a pair in its band of sizes may differ
in. If a set has members in more parts than that, one of these is the same in both sets of any linked pair: each
part's hash is a tree's key. If that holds of its parts with two members or more, the others are no keys: a member
that very many sets have, alone in its part, then brings few of them together. A set whose members fall into too few
parts is dealt anew by another hash, until they don't; two such sets meet in the first dealing that suits one of them.
So no key is free of content.

Trees with classes in common are merged, and cut by size (powers of two, a class near the lower bound going to both
sides), so that a class's members are shipped once or twice. A tree's nodes hold the OR of their sets' token bitmaps
(at least 16 bits a member), their range of sizes and of labels; a dual traversal drops pairs of nodes whose largest
possible overlap is too small, whose sizes are too far apart, or that have one label throughout. A pair of leaves
that is left is checked on the whole sets, unless they are connected by then; so a block of classes gives fewer links
than it has classes. Large trees are cut into blocks. Each block first meets a few classes of the whole tree; blocks
are then formed anew by the labels found, and pairs of blocks with different labels are traversed in the same way.

Defined results: null, empty and blank texts have no members and are their own component; rows that repeat a
doc_id are handled each for itself; rows without doc_id link, but give no id to a component; other columns are
left out; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, dropped, gram_hashes, mix64, ranges, small_batches, words, written
from .components import Groups, components, stars

#: Members of the sets in one block at most (but for a single larger set), and classes in one block at most.
BLOCK_MEMBERS, BLOCK_CLASSES = 1 << 20, 512
#: Classes of a large tree, on average, that all its blocks meet.
HEADS = 16
#: Children of a node. Four unrelated sets' bitmaps, OR-combined, still tell two such nodes apart.
FAN = 4
#: Sets of a block are sorted by size, in steps of this factor, before likeness.
STEP = 1.06
#: Keys that a task looks through at once for classes that already share a tree.
KEYS = 1 << 20
#: Passes in which near-duplicates' keys are shuffled, some 230 a class at 4/5.
PASSES = 2
#: Members of the sets that a task holds, and of those that it reads against them, when blocks of a tree meet.
HELD_MEMBERS, READ_MEMBERS = 1 << 21, 1 << 23
#: Classes with more than this share of the rows are broadcast at the end: fewer than this many.
HOT = 10_000
#: Bits of the sieve that spares texts without a candidate a second pass, at most (8 MB).
FILTER_BITS = 1 << 26
GOLD = np.uint64(0x9E3779B97F4A7C15)


def member_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of each text's distinct runs of k words, one text after the other, and where each text's start."""
    h, _, first, _ = words(texts, lower=True)
    n = np.diff(first)
    runs = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    at = np.r_[0, np.cumsum(runs)]
    flat = np.empty(at[-1], np.uint64)
    long = np.flatnonzero(n >= k)
    grams = gram_hashes(h, k)
    flat[ranges(at[long], runs[long])] = grams[ranges(first[long], runs[long])]
    for d in np.flatnonzero((n > 0) & (n < k)):
        flat[at[d]] = gram_hashes(h[first[d] : first[d + 1]], int(n[d]))[0] + np.uint64(n[d])
    for d in long:
        flat[at[d] : at[d + 1]].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[at[:-1][runs > 0]] = True
    return flat[new], np.r_[0, np.cumsum(new)][at]


def most_apart(size: int, num: int, den: int) -> int:
    """The largest symmetric difference of a linked pair whose smaller set has at most `size` members."""
    return (size + size * den // num) * (den - num) // (den + num)


@functools.lru_cache(maxsize=32)
def bands(most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands of sizes, each a quarter as wide as its least size, up to `most` members: largest size, what a linked pair
    may differ in, and parts that sets are dealt into: so many that most sets have two members or more in more parts
    than a pair may differ in, if that can be."""
    highs, aparts, parts, low = [], [], [], 1
    while not highs or highs[-1] < most:
        high = low + low // 4
        apart = most_apart(high, num, den)
        p = np.unique(np.linspace(apart + 1, 3 * apart + 1, 400).astype(np.int64))
        share = 1 - np.exp(-low / p) * (1 + low / p)
        sure = p * share - np.sqrt(p * share * (1 - share)) - apart
        highs.append(high)
        aparts.append(apart)
        parts.append(int(p[np.argmax(sure > 0) if (sure > 0).any() else np.argmax(sure)]) if apart else 1)
        low = high + 1
    return np.array(highs), np.array(aparts), np.array(parts)


def _dealt(m: np.ndarray, mixed: np.ndarray, entry: np.ndarray, parts: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all parts with members, each key's entry, and how many members its part has. Members are in order within an entry; parts and base: of an entry."""
    at = ((m >> np.uint64(32)) * parts[entry]) >> np.uint64(32)
    new = np.ones(len(m), bool)
    new[1:] = (at[1:] != at[:-1]) | (entry[1:] != entry[:-1])
    cells = np.flatnonzero(new)
    counts = np.diff(np.r_[cells, len(m)]).astype(np.uint64)
    return mix64(np.add.reduceat(mixed, cells) + counts * GOLD + mix64(at[cells] + base[entry[cells]])), entry[cells], counts


def tree_keys(flat: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all trees of each set, and the sets' numbers. flat, at: as from member_sets."""
    n = np.diff(at)
    has = np.flatnonzero(n)
    if not len(has):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    highs, aparts, parts = bands(1 << int(n.max() - 1).bit_length(), num, den)
    low, high = np.searchsorted(highs, -(-n[has] * num // den)), np.searchsorted(highs, n[has])
    # An entry is a set in one of its bands.
    owner, band = np.repeat(has, high - low + 1), ranges(low, high - low + 1)
    entry = np.repeat(np.arange(len(owner)), n[owner])
    where = ranges(at[owner], n[owner])
    base = mix64(band.astype(np.uint64) * np.uint64(4) + np.uint64(1))
    keys, of, counts = _dealt(flat[where], mix64(flat ^ GOLD)[where], entry, parts.astype(np.uint64)[band], base)
    # A part of one member is no key of a set that has more larger parts than a pair may differ in: one of these is shared.
    larger = np.bincount(of[counts > 1], minlength=len(owner)) > aparts[band]
    kept = (counts > 1) | ~larger[of]
    all_keys, owners = [keys[kept]], [owner[of[kept]]]
    for e in np.flatnonzero(np.bincount(of, minlength=len(owner)) <= aparts[band]):
        h, b, deal, used = flat[at[owner[e]] : at[owner[e] + 1]], band[e], 0, 0
        while used <= aparts[b]:
            deal += 1
            again = np.sort(mix64(h + np.full(1, deal, np.uint64) * GOLD))
            keys, _, _ = _dealt(again, mix64(again ^ GOLD), np.zeros(len(h), np.int64), parts[b : b + 1].astype(np.uint64), mix64(base[e : e + 1] + np.uint64(deal)))
            used = len(keys)
            all_keys.append(keys)
            owners.append(np.full(used, owner[e]))
    return np.concatenate(all_keys), np.concatenate(owners)


def fewer_keys(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which keys to keep so that the same sets are connected: of each key its first set's, and one of each other
    set with the same first set. So a popular tree has few rows when it is shuffled."""
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owners[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = o[np.flatnonzero(new)][np.cumsum(new) - 1]
    rest = np.flatnonzero(~new & (first != o))
    _, one = np.unique(np.stack([first[rest], o[rest]]), axis=1, return_index=True) if len(rest) else (None, rest)
    new[rest[one]] = True
    return order[new]


# Trees


def bitmap_width(octave: int) -> int:
    """Bits for sets of 2^octave members or more, less than twice as many: at least 16 a member."""
    return max(64, 1 << (octave + 5))


def bitmap(h: np.ndarray, width: int) -> np.ndarray:
    """A set's token bitmap."""
    bits = np.zeros(width, np.uint8)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


class Block:
    """Classes in order, with their sets, as the leaves of a signature tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], width: int):
        self.ids, self.labels, self.sets = ids, labels, sets
        bits = np.stack([bitmap(s, width) for s in sets])
        sizes = np.array([len(s) for s in sets])
        ones = np.bitwise_count(bits).sum(1).astype(np.int64)
        #: Level by level from the leaves: bitmaps, least and largest size, least number of set bits, lowest and highest label.
        self.levels = [(bits, sizes, sizes, ones, labels, labels)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, few, l0, l1 = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(few, at), np.minimum.reduceat(l0, at), np.maximum.reduceat(l1, at)))


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of nodes may hold a link between different labels."""
    keep = ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
    keep &= (x[2][i] * den >= y[1][j] * num) & (y[2][j] * den >= x[1][i] * num)
    live = np.flatnonzero(keep)
    for at in range(0, len(live), 4096):
        part = live[at : at + 4096]
        common = np.bitwise_count(x[0][i[part]] & y[0][j[part]]).sum(1).astype(np.int64)
        apart = x[3][i[part]] + y[3][j[part]] - 2 * common
        keep[part] = apart * (den + num) <= (den - num) * (x[2][i[part]] + y[2][j[part]])
    return keep


def dual_traversal(x: Block, y: Block, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of classes with different labels, of two blocks (or of one, given twice), whose bitmaps allow a link."""
    same = x is y
    depth = max(len(x.levels), len(y.levels)) - 1
    level = lambda b, d: b.levels[min(d, len(b.levels) - 1)]

    def children(block: Block, nodes: np.ndarray, d: int) -> tuple[np.ndarray, int]:
        if d > len(block.levels) - 1:
            return nodes[:, None], 1
        return nodes[:, None] * FAN + np.arange(FAN), FAN

    i = j = np.zeros(1, np.int64)
    for d in range(depth, -1, -1):
        keep = _possible(level(x, d), level(y, d), i, j, num, den)
        i, j = i[keep], j[keep]
        if d:
            (ci, a), (cj, b) = children(x, i, d), children(y, j, d)
            i, j = np.repeat(ci, b, axis=1).ravel(), np.tile(cj, (1, a)).ravel()
            inside = (i < len(level(x, d - 1)[0])) & (j < len(level(y, d - 1)[0]))
            if same:
                inside &= i <= j
            i, j = i[inside], j[inside]
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def links(x: Block, y: Block, num: int, den: int) -> tuple[list[int], list[int]]:
    """Links between classes of two blocks (or of one, given twice), by their whole sets, as pairs of labels: as few as
    connect what all links connect."""
    i, j = dual_traversal(x, y, num, den)
    groups = Groups()
    find = groups.find
    a, b = [], []
    lx, ly = x.labels.tolist(), y.labels.tolist()
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        one, two = find(lx[p]), find(ly[q])
        if one != two:
            s, t = x.sets[p], y.sets[q]
            common = len(np.intersect1d(s, t, assume_unique=True))
            if common * den >= num * (len(s) + len(t) - common):
                groups.join(one, two)
                a.append(lx[p])
                b.append(ly[q])
    return a, b


# The join


def text_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, text, cid: equal texts are one class."""
    return documents(docs).withColumn("cid", F.xxhash64("text"))


def sizes(docs: DataFrame, k: int) -> DataFrame:
    """cid, n: how many members each class's set has."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _new(batches):
            yield pa.RecordBatch.from_arrays([b["cid"], pa.array(np.diff(member_sets(b["text"], k)[1]))], ["cid", "n"])

    return text_hashes(docs).select("cid", "text").mapInArrow(run, "cid long, n long").dropDuplicates(["cid"])


def _new(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose class the task hasn't met yet."""
    seen: set[int] = set()
    for b in batches:
        new = []
        for cid in b["cid"].to_pylist():
            new.append(cid not in seen)
            seen.add(cid)
        yield b.filter(pa.array(new, pa.bool_()))


def routes(docs: DataFrame, k: int, num: int, den: int, part: int = 0, parts: int = 1) -> DataFrame:
    """key, cid: the trees of each class (but for those that fewer_keys spares) whose key modulo parts is part."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys, cids = (np.concatenate(c) for c in zip(*held, strict=True))
            _, owners = np.unique(cids, return_inverse=True)
            kept = fewer_keys(keys, owners)
            return pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(cids[kept])], ["key", "cid"])

        for b in _new(batches):
            keys, owners = tree_keys(*member_sets(b["text"], k), num, den)
            if parts > 1:
                own = keys % np.uint64(parts) == part
                keys, owners = keys[own], owners[own]
            held.append((keys, b["cid"].to_numpy()[owners]))
            if sum(len(h[0]) for h in held) >= KEYS:
                yield flush()
                held = []
        if held:
            yield flush()

    return text_hashes(docs).select("cid", "text").mapInArrow(run, "key long, cid long")


def _sieve(cids: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of bounded size with two bits a value, from column cid: its width and its words."""
    count = cids.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    at = cids.select(F.explode(F.array(F.pmod("cid", F.lit(bits)), F.pmod(F.xxhash64("cid"), F.lit(bits)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect()
    table = np.zeros(bits >> 6, np.int64)
    table[[w[0] for w in words]] = [w[1] for w in words]
    return bits, table


def _sieved(cids: DataFrame) -> Callable[[Column], Column]:
    """A test whether a long may be in column cid: true for all that are, and for few others."""
    bits, table = _sieve(cids)
    shared = cids.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def has(p: pd.Series, q: pd.Series) -> pd.Series:
        words = np.frombuffer(shared.value, np.uint64)
        in_both = np.ones(len(p), np.uint64)
        for at in (p.to_numpy(), q.to_numpy()):
            in_both &= words[at >> 6] >> (at & 63).astype(np.uint64)
        return pd.Series((in_both & np.uint64(1)).astype(bool))

    return lambda cid: has(F.pmod(cid, F.lit(bits)), F.pmod(F.xxhash64(cid), F.lit(bits)))


def _dealt_sets(docs: DataFrame, places: DataFrame, k: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """key, octave, salt, head, cid, label, members: the sets of the classes in places, brought to their trees and in
    order there. places: cid, label, key, octave, head, salts. Texts are not shuffled: a sieve drops most rows before
    their words are hashed, and sets are joined with their places. Also the places as they were written."""
    spark = docs.sparkSession
    small_batches(spark)
    places = written(places, "places")
    bits, table = _sieve(places.select("cid").distinct())
    shared = spark.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(shared.value, np.uint64)
        has = lambda at: (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        for b in batches:
            p, q = (b[c].to_numpy().astype(np.int64) for c in ("p", "q"))
            b = next(_new([b.filter(pa.array((has(p) & has(q)).astype(bool)))]))
            flat, at = member_sets(b["text"], k)
            yield pa.RecordBatch.from_arrays([b["cid"], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))], ["cid", "members"])

    rows = text_hashes(docs).select("cid", "text", F.pmod("cid", F.lit(bits)).alias("p"), F.pmod(F.xxhash64("cid"), F.lit(bits)).alias("q"))
    sets = rows.mapInArrow(run, "cid long, members array<long>").dropDuplicates(["cid"])
    placed = sets.join(places, "cid").select("key", "octave", F.explode("salts").alias("salt"), "head", "cid", "label", "members")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "key", "octave", "salt").sortWithinPartitions("key", "octave", "salt", *order, "cid"), places


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list[tuple]]]:
    """(key, octave, salt), number, rows (cid, label, members) of each block; a tree's heads are in all of its blocks."""
    tree, heads, rows, total, seq = None, [], [], 0, 0
    for batch in batches:
        lists = batch["members"]
        flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        names = [batch[c].to_pylist() for c in ("key", "octave", "salt", "head", "cid", "label")]
        for i, (key, octave, salt, head, cid, label) in enumerate(zip(*names, strict=True)):
            n = int(at[i + 1] - at[i])
            other = (key, octave, salt) != tree
            if rows and (other or len(rows) >= BLOCK_CLASSES or total + n > BLOCK_MEMBERS):
                yield tree, seq, heads + rows
                rows, total, seq = [], 0, seq + 1
            if other:
                if len(heads) > 1 and not seq:
                    yield tree, seq, heads
                tree, heads, seq = (key, octave, salt), [], 0
            row = (cid, label, flat[at[i] : at[i + 1]].copy())
            if head:
                heads.append(row)
            else:
                rows.append(row)
                total += n
    if rows or (len(heads) > 1 and not seq):
        yield tree, seq, heads + rows


def _block(octave: int, rows: list[tuple]) -> Block:
    # Sets of like size whose least hashes are equal are neighbours: their node's bitmap is not much fuller than theirs.
    rows = sorted(rows, key=lambda r: (int(np.log(len(r[2])) / np.log(STEP)), r[2][0]))
    return Block(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], bitmap_width(octave))


def in_blocks(sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links, as pairs of labels, that connect what the blocks' own links connect."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for (_, octave, _), _, rows in _cut(batches):
            if len(rows) > 1:
                block = _block(octave, rows)
                one, two = links(block, block, num, den)
                a += one
                b += two
            if len(a) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sets.mapInArrow(run, "a long, b long")


def across_blocks(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """a, b: different labels with a link, in one block of a large tree or in two; and the tables written for it."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("key", pa.int64()), ("octave", pa.int32()), ("block", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("l0", pa.int64()), ("l1", pa.int64()), ("ids", longs), ("labels", longs), ("sizes", longs), ("members", pa.binary()), ("a", longs), ("b", longs)])
    ddl = "key long, octave int, block string, low long, high long, l0 long, l1 long, ids array<long>, labels array<long>, sizes array<long>, members binary, a array<long>, b array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, octave, salt), seq, rows in _cut(batches):
            block = _block(octave, rows)
            sizes = [len(s) for s in block.sets]
            a, b = links(block, block, num, den)
            row = {"key": key, "octave": octave, "block": f"{salt}-{seq}", "low": min(sizes), "high": max(sizes), "l0": block.labels.min(), "l1": block.labels.max(), "ids": block.ids, "labels": block.labels, "sizes": sizes, "members": np.concatenate(block.sets).tobytes(), "a": a, "b": b}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    blocks = written(sets.mapInArrow(run, ddl), "blocks")
    # Pairs of blocks are dealt by cells: some neighbours in size, which a task holds, by more of them, which it reads one
    # by one. So a block is shipped to each cell that it is in, not for each other block that it meets.
    tree = Window.partitionBy("key", "octave").orderBy("low", "block")
    before = F.sum(F.length("members") / 8).over(tree.rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(before, F.lit(0))
    brief = blocks.select("key", "octave", "block", "low", "high", "l0", "l1", F.row_number().over(tree).alias("place"), F.floor(before / HELD_MEMBERS).alias("held"), F.floor(before / READ_MEMBERS).alias("read"))
    brief = written(brief, "brief")
    x, y = brief.alias("x"), brief.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.octave") == F.col("y.octave")) & (F.col("x.place") < F.col("y.place")) & ~F.expr("x.l0 = x.l1 and y.l0 = y.l1 and x.l0 = y.l0") & (F.col("x.high") * den >= F.col("y.low") * num) & (F.col("y.high") * den >= F.col("x.low") * num))
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"{t}.block").alias("block"), F.col(f"{t}.place").alias("place")) for i, t in enumerate("xy")))).alias("s")
    cells = met.select("x.key", "x.octave", "x.held", "y.read", sides).select("key", "octave", "held", "read", "s.*").distinct()
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.join(blocks.select("key", "octave", "block", "ids", "labels", "sizes", "members"), ["key", "octave", "block"])
    dealt = dealt.repartition(parts, "key", "octave", "held", "read").sortWithinPartitions("key", "octave", "held", "read", "side", "place")

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            names = [batch[c].to_pylist() for c in ("key", "octave", "held", "read", "side", "place")]
            for i, (*here, side, place) in enumerate(zip(*names, strict=True)):
                if here != cell:
                    cell, held = here, []
                ids, labels, sizes = (np.array(batch[c][i].as_py()) for c in ("ids", "labels", "sizes"))
                block = Block(ids, labels, np.split(np.frombuffer(batch["members"][i].as_py(), np.uint64), np.cumsum(sizes)[:-1]), bitmap_width(here[1]))
                if side == 0:
                    held.append((place, block))
                    continue
                for other in (b for p, b in held if p < place):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links(other, block, num, den)], ["a", "b"])

    own = blocks.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
    return own.union(dealt.mapInArrow(across, "a long, b long")), [blocks, brief]


def shared_trees(docs: DataFrame, k: int, num: int, den: int, passes: int) -> DataFrame:
    """a, b: classes of one tree, as stars. Keys are far more than texts, so they are shuffled in passes, each with its
    share of all keys; only its stars are left when the next begins. A class's edges, at most one a key, are brought to
    one task and made distinct there: so stars have no more rows than different edges, into however many tasks keys fall."""
    pivot = F.first("cid").over(Window.partitionBy("key").orderBy("cid"))
    each = (routes(docs, k, num, den, part, passes).select(pivot.alias("a"), F.col("cid").alias("b")).filter("a <> b").repartition("b").distinct() for part in range(passes))
    if passes == 1:
        return next(each)
    return functools.reduce(DataFrame.union, [written(stars(edges).distinct(), "trees") for edges in each])


def class_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, passes: int = 1) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cid of each row; cid, n, component, root, copies of each class). The root tells components apart whose
    smallest doc_id is the same, as rows may repeat one."""
    rows = written(text_hashes(docs).select("doc_id", "cid"), "rows")
    sized = written(sizes(docs, k), "sizes")
    shared = shared_trees(docs, k, num, den, passes)
    merged = components(shared).select(F.col("node").alias("cid"), F.col("root").alias("key"))

    octaves = F.array_distinct(F.transform(F.array(F.col("n"), F.ceil(F.col("n") * num / den)), lambda n: (F.length(F.bin(n)) - 1).cast("int")))
    placed = written(sized.join(merged, "cid").select("*", F.explode(octaves).alias("octave")), "placed")
    groups = placed.groupBy("key", "octave").agg(F.count("*").alias("count"), F.sum("n").alias("weight")).filter("count > 1")
    heavy = (F.col("weight") > BLOCK_MEMBERS) | (F.col("count") > BLOCK_CLASSES)
    salts = F.ceil(F.greatest(F.col("weight") / (16 * BLOCK_MEMBERS), F.col("count") / (16 * BLOCK_CLASSES)))
    groups = written(groups.select("key", "octave", "count", heavy.alias("heavy"), salts.alias("n_salts")), "groups")
    each = placed.join(groups, ["key", "octave"])
    head = F.col("heavy") & (F.pmod(F.xxhash64("cid"), F.col("count")) < HEADS)
    salt = F.when(head, F.sequence(F.lit(0).cast("long"), F.col("n_salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid", "octave"), F.col("n_salts"))))
    dealt, used = _dealt_sets(docs, each.select("cid", F.col("cid").alias("label"), "key", "octave", head.alias("head"), salt.alias("salts")), k, "head")
    roots = components(in_blocks(dealt, num, den))
    # Each table goes when what is made of it has been written.
    done = [sized, placed, groups, used, merged, roots, *([shared] if passes > 1 else [])]
    if not groups.filter("heavy").isEmpty():
        labels = roots.select(F.col("node").alias("cid"), F.col("root").alias("label"))
        named = written(each.filter("heavy").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "named")
        still = named.groupBy("key", "octave").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("key", "octave")
        # Blocks of like sizes, so that many pairs of blocks are too far apart in size.
        step = F.floor(F.log("n") / F.log(F.lit(STEP))).cast("long")
        salt = F.array(step * F.col("n_salts") + F.pmod(F.xxhash64("label"), F.col("n_salts")))
        dealt, used = _dealt_sets(docs, named.join(still, ["key", "octave"]).select("cid", "label", "key", "octave", F.lit(False).alias("head"), salt.alias("salts")), k, "label")
        across, tables = across_blocks(dealt, num, den)
        more = components(across)
        done += [named, used, *tables, more]
        # Labels that links connect get one root; classes that had no link are their own label.
        further = more.select(F.col("node").alias("root"), F.col("root").alias("further"))
        alone = more.join(roots, "node", "left_anti")
        roots = roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root")).union(alone.select("node", "root"))

    classes = rows.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    linked = written(classes.join(sized, "cid").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left"), "linked")
    least = linked.filter("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    known = linked.join(least, "root", "left").select("cid", "n", F.coalesce("least", "rep").alias("component"), F.coalesce("root", "cid").alias("root"), "copies")
    known = written(known, "known")
    for table in [*done, linked]:
        dropped(table)
    return rows, known


def similarity_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; links need num/den of the union in common."""
    rows, known = class_components(docs, k, num, den)
    joined = by_class(rows, known)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def by_class(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with the columns of known. Texts with many copies, fewer than HOT of them, are broadcast; so no text's copies
    meet in one task."""
    many = max(64, rows.count() // HOT)
    hot = F.broadcast(known.filter(F.col("copies") > many))
    first = rows.join(hot, "cid", "left")
    rest = first.filter("copies is null").select(*rows.columns).join(known.filter(F.col("copies") <= many), "cid")
    return first.filter("copies is not null").select(*rest.columns).unionByName(rest)


def survivors(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs that stay, all columns: of each component the row with the smallest doc_id, rows that repeat it
    being one. Rows without words stay, but rows that repeat one's doc_id are one too; rows without doc_id all stay."""
    rows, known = class_components(docs, k, num, den, passes=PASSES)
    stays = (F.col("doc_id") == F.col("component")) | (F.col("n") == 0)
    seen = by_class(rows.filter("doc_id is not null"), known).groupBy("doc_id", "cid").agg(F.count("*").alias("rows"), F.first("n").alias("n"), F.first("root").alias("root"), F.first(stays).alias("stays"))
    # Different texts of one doc_id may be in one component: the least hash decides.
    one = F.row_number().over(Window.partitionBy("doc_id", "stays", F.when(F.col("n") > 0, F.col("root"))).orderBy("cid")) == 1
    seen = written(seen.select(F.col("doc_id").alias("kept_id"), F.col("cid").alias("kept_cid"), "rows", (F.col("stays") & one).alias("stays")), "seen")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    body = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("cid"))
    same = (F.col("doc_id") == F.col("kept_id")) & (F.col("cid") == F.col("kept_cid"))
    # What goes, and what is repeated, is the smaller part: a sieve tells most other rows, whose texts then aren't shuffled.
    gone = written(seen.filter("not stays or rows > 1").select("kept_id", "kept_cid"), "gone")
    perhaps = _sieved(gone.select(F.xxhash64("kept_id", "kept_cid").alias("cid")))(F.xxhash64("doc_id", "cid"))
    out = body.filter(~perhaps).select("doc.*").union(body.filter(perhaps).join(gone, same, "left_anti").select("doc.*"))
    dropped(rows)
    dropped(known)
    repeated = seen.filter("stays and rows > 1")
    if repeated.isEmpty():
        dropped(seen)
        return out
    return out.unionByName(body.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "cid"]).select("doc.*"))
