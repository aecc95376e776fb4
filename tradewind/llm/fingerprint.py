"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions alone.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector, and a fingerprint
is the sum of these vectors modulo 2^48, so it doesn't depend on the paragraphs' order, and a paragraph is
inserted or deleted by adding or subtracting its vector. The vector has: a count of paragraphs, a count of
word triples (each word with its neighbours in the line; the middle of a word thrice in a row is left out), sums
of whole-paragraph hashes (for equality), and a sketch. Each of the sketch's 96 counters is a long of its own and
sums one bit of the hash of every word triple, so the differences between two fingerprints' counters estimate how
many triples two texts don't share. A text has under 2^31 words, so no counter of one can reach 2^48.

Words are exploded to rows and summed again by document before any shuffle, all in generated code.

Defined results: null texts are empty; equal texts, and texts with the same paragraphs, have equal
fingerprints and likeness 1; two texts without words are alike. Rows that repeat a doc_id all have the next
larger doc_id as the next document (of its texts, the smallest; of its fingerprints, the smallest).
Rows without doc_id stand outside the order: nothing follows them. Further columns are left out; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

#: All sums are modulo 2^48: those of 2^27 words still fit a long before they are cut.
MASK = (1 << 48) - 1
EQUALITY_SUMS = 4
#: Two counters are summed in one long: a text, an array of under 2^31 words, can't carry one into the other.
LANE_BITS, LANES = 32, 2
#: Two hashes of 24 shifts of two lanes: 96 counters.
HASHES, SHIFTS = 2, 24
_ONES = sum(1 << (LANE_BITS * k) for k in range(LANES))
COUNTERS = HASHES * SHIFTS * LANES
FIRST_SKETCH = 2 + EQUALITY_SUMS
WIDTH = FIRST_SKETCH + COUNTERS


def _plus(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(F.lit(MASK))


def of_texts(df: DataFrame, keys: list[str], text: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """keys, kept, fingerprint array<long>: of column `text`, for rows that differ in their keys.

    All that is summed or kept is long, so that Spark sums in a hash table."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)

    def of_lines(j: int) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, p: _plus(acc, F.xxhash64(p, F.lit(j)).bitwiseAND(F.lit(MASK))))

    # Each line break is a word of its own, and one more stands at either end, so that the split has an empty first and last piece.
    words = F.split(F.replace(F.concat(F.lit("\n"), t, F.lit("\n")), F.lit("\n"), F.lit(" \n ")), "[ \\t\\r\\f\\x0B]+", -1)
    whole = {"lines": F.size(lines).cast("long"), **{f"line{j}": of_lines(j) for j in range(EQUALITY_SUMS)}}
    once = [*whole, *kept]
    rows = df.select(*keys, *kept, *(c.alias(n) for n, c in whole.items()), words.alias("words"))
    rows = rows.select(*keys, *once, "words", F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("i"))
    before, word, after = (F.get("words", F.col("i") + d) for d in (-1, 0, 1))
    counted = (word != "\n") & ((before != word) | (word != after))
    rows = rows.select(*keys, *once, "i", F.when(counted, F.xxhash64(before, word, after)).alias("h0"))
    rows = rows.withColumn("h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0", F.lit(1))))
    sums = [F.sum(F.shiftrightunsigned(f"h{x}", j).bitwiseAND(F.lit(_ONES))).alias(f"s{x}_{j}") for x in range(HASHES) for j in range(SHIFTS)]
    first = [F.max(F.when(F.col("i") == 1, F.col(c))).alias(c) for c in once]
    summed = rows.groupBy(*keys).agg(F.count("h0").alias("n"), *first, *sums)
    packed = [F.coalesce(F.col(f"s{x}_{j}"), F.lit(0)) for x in range(HASHES) for j in range(SHIFTS)]
    sketch = [F.shiftrightunsigned(s, LANE_BITS * k).bitwiseAND(F.lit((1 << LANE_BITS) - 1)) for s in packed for k in range(LANES)]
    return summed.select(*keys, *kept, F.array("lines", "n", *(f"line{j}" for j in range(EQUALITY_SUMS)), *sketch).alias("fingerprint"))


def inserted(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint after paragraphs, given by their own fingerprint, come in."""
    return F.zip_with(fingerprint, paragraphs, _plus)


def deleted(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint after paragraphs, given by their own fingerprint, go."""
    return F.zip_with(fingerprint, paragraphs, lambda a, b: (a - b).bitwiseAND(F.lit(MASK)))


def _size(a: Column, b: Column) -> Column:
    """The estimated sum of squares of the differences between two multisets' counts of triples."""
    n = (F.get(a, F.lit(1)) - F.get(b, F.lit(1))).cast("double")
    counters = (F.slice(f, FIRST_SKETCH + 1, COUNTERS) for f in (a, b))
    # A counter's difference around its expected middle, doubled.
    apart = F.zip_with(*counters, lambda x, y: 2.0 * (x - y) - n)
    return F.aggregate(apart, F.lit(0.0), lambda acc, d: acc + d * d) / COUNTERS


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one minus the estimated difference of two fingerprints over their own estimated sizes."""
    none = F.array(*[F.lit(0).cast("long")] * WIDTH)
    whole = _size(a, none) + _size(b, none)
    # Nothing over nothing is null, which greatest and least pass over: two empty texts are alike.
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.try_divide(_size(a, b), whole))))


def as_string(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, prev_id, prev_chars of each distinct doc_id, in ascending order and round the end.

    Range partitions are put in order each for itself; their first and last ids, a row for each partition,
    join them up."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).cast("long").alias("chars"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = written(ids.repartitionByRange(n, "doc_id").withColumn("range", F.spark_partition_id()), "order")
    inside = Window.partitionBy("range").orderBy("doc_id")
    ends = ids.groupBy("range").agg(F.min("doc_id").alias("low"), F.max_by(F.struct("doc_id", "chars"), "doc_id").alias("high"))
    over = Window.orderBy("low")
    first, last = F.min("low").over(Window.partitionBy()), F.max("high").over(Window.partitionBy())
    ends = ends.select("range", F.coalesce(F.lead("low").over(over), first).alias("after"), F.coalesce(F.lag("high").over(over), last).alias("before"))
    prev = F.lag(F.struct("doc_id", "chars")).over(inside)
    linked = ids.withColumn("next", F.lead("doc_id").over(inside)).withColumn("prev", prev).join(ends, "range")
    prev = F.coalesce("prev", "before")
    return linked.select("doc_id", F.coalesce("next", "after").alias("next_id"), prev["doc_id"].alias("prev_id"), prev["chars"].alias("prev_chars"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, row, text, next_id, edited: the last quarter of each text replaced by the start of the next document.

    `row` tells rows of one doc_id apart; it is counted where the join has them together, so that no text moves again."""
    docs = documents(docs)
    known = docs.filter("doc_id is not null")
    order = written(neighbours(docs), "neighbours").withColumnRenamed("doc_id", "key")
    # Both uses of `placed` read the same shuffle of the texts.
    placed = known.join(order.hint("shuffle_hash"), known["doc_id"] == order["key"]).drop("key")
    heads = placed.select(F.col("prev_id").alias("of"), F.expr("substring(text, 1, cast(prev_chars div 4 as int))").alias("head"))
    heads = heads.groupBy("of").agg(F.min("head").alias("head"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))).cast("long")
    both = placed.join(heads, placed["doc_id"] == heads["of"], "left").select("doc_id", number.alias("row"), "text", "next_id", "head")
    rest = docs.filter("doc_id is null").select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("string").alias("head"))
    chars = F.length("text")
    quarter = F.expr("cast(length(text) div 4 as int)")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - quarter), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter))
    return both.union(rest).select("doc_id", "row", "text", "next_id", edited.alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = edited_texts(docs)
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    texts = texts.select("doc_id", "row", "next_id", F.length("text").cast("long").alias("n_chars"), "text", "edited", sha.alias("sha"))
    # A digest goes along as four longs.
    parts = [F.conv(F.substring("sha", 1 + 16 * k, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    facts = ("next_id", "n_chars", *(f"sha{k}" for k in range(4)))
    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"))))
    two = texts.select("doc_id", "row", "next_id", "n_chars", *parts, both.alias("x")).select("doc_id", "row", *facts, "x.which", "x.t")
    prints = of_texts(two, ["doc_id", "row", "which"], "t", facts)
    of = lambda which: F.max(F.when(F.col("which") == which, F.col("fingerprint")))
    df = prints.groupBy("doc_id", "row").agg(*(F.max(c).alias(c) for c in facts), of(0).alias("own"), of(1).alias("changed"))
    digest = F.concat(*(F.lpad(F.lower(F.hex(f"sha{k}")), 16, "0") for k in range(4)))
    df = df.select("doc_id", "row", "next_id", "n_chars", digest.alias("edited_sha256"), "own", "changed")
    df = written(df.drop("row"), "fingerprints")
    following = df.filter("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.min("own").alias("next_own"))
    df = df.join(following, df["next_id"] == following["key"], "left")
    empty = F.array(*[F.lit(0).cast("long")] * WIDTH)
    return df.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.coalesce("next_own", empty)).alias("near_next"),
    )
