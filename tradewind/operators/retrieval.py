"""Retrieval: BM25 over an inverted table, exact dense scores, their fusion, and context windows.

A text is cut into words once, a batch of texts at a time, and leaves one row with the numbers and counts of the terms
that some query asks for; these rows are checkpointed. The corpus' statistics come from them, and so do the scores: each
task scores its own texts for all queries and keeps each query's best, so that neither postings nor scores are shuffled.
Where queries ask for more terms than a task should hold, postings are rows that are shuffled and joined with the queries'
terms. Queries may be limited to groups of texts. Scores are sums of whole numbers, so that they don't depend on the order
of summing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions.text import pairs, unigrams, with_bigrams
from ..functions.words import words as words_of
from ..session import checkpointed, small_batches

K1, B = 1.5, 0.75
CANDIDATES, FINAL = 30, 10
VECTOR_WEIGHT, BM25_WEIGHT, BOTH_BONUS = 0.62, 0.38, 0.05
#: Query terms that are sent to every executor at most; more are shuffled.
MOST_BROADCAST_ROWS = 200_000
#: Stands for a text among its terms; no term has a space.
TEXT = " text"


#: Query vectors that are sent to every executor at once.
VECTOR_BATCH = 1_000
#: Queries whose scores a task holds side by side at most; with more, postings are rows.
MOST_COLUMNS = 10_000
#: Scores of texts and queries, and meetings of their terms, that a task works on at once.
CELLS = 1_000_000
#: Parts of 1 that weights are counted in, and the bits of a sum's lower half.
UNIT, HALF = 10**12, 24


def terms(text: Column) -> Column:
    return with_bigrams(text)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files have fewer splits than there are cores: a text takes long to cut into terms."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avg_length (at least 1)."""
    words = F.size(unigrams(F.col("text")))
    n = F.greatest(2 * words - 1, F.lit(0)).cast("long")
    return docs.agg(F.count("*").alias("n_docs"), F.greatest(F.sum(n).cast("double") / F.count("*"), F.lit(1.0)).alias("avg_length"))


def term_stats(docs: DataFrame) -> DataFrame:
    """term, df, idf."""
    n = docs.agg(F.count("*").alias("n_docs"))
    words = docs.select("doc_id", unigrams(F.col("text")).alias("w"))
    df = words.select("doc_id", F.explode(F.array_distinct(F.concat("w", pairs(F.col("w"))))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, words, terms (words and pairs of neighbours), distinct_words (of three letters or more, no numbers)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = words_of(batch.column("text"))
            n = np.diff(first)
            coded = found.dictionary_encode()
            counted = pc.and_(pc.greater_equal(pc.binary_length(coded.dictionary), 3), pc.match_substring_regex(coded.dictionary, "[^0-9]")).to_numpy(zero_copy_only=False).astype(bool)
            word, text = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
            code = np.unique((text * max(len(counted), 1) + word)[counted[word]])
            distinct = np.bincount(code // max(len(counted), 1), minlength=len(n))
            columns = (n, np.maximum(2 * n - 1, 0), distinct)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "words", "terms", "distinct_words"])

    schema = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("words", "terms", "distinct_words"))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def postings(docs: DataFrame, asked: DataFrame, few: bool, *kept: str) -> DataFrame:
    """doc_id, kept columns, length, term, tf for the terms asked for, and one row with TEXT for each document."""
    cut = spread(docs).select("doc_id", *kept, unigrams(F.col("text")).alias("w"))
    length = F.greatest(2 * F.size("w") - 1, F.lit(0)).cast("long")
    # Each word with its right neighbour; a text without words keeps one row of nulls.
    words = cut.select("doc_id", *kept, length.alias("length"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("w"), F.slice("w", F.lit(2), F.size("w")).alias("next"))).alias("at", "x"))
    pair = F.when(F.col("x.next").isNotNull(), F.concat("x.w", F.lit("_"), "x.next"))
    mark = F.when(F.coalesce("at", F.lit(0)) == 0, TEXT)
    terms_of = words.select("doc_id", *kept, "length", F.explode(F.array(F.col("x.w"), pair, mark)).alias("term")).filter("term is not null")
    wanted = asked.unionByName(asked.sparkSession.createDataFrame([(TEXT,)], "term string"))
    return terms_of.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy("doc_id", *kept, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, groups: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score. docs: doc_id, text, with groups also source. queries: query_id, question. A repeated
    query term counts twice; texts of one doc_id count each, and their scores are summed. groups: query_id, source, the
    groups that a query is limited to; queries with none, or with none that any document has, look at all documents.
    Statistics are those of all documents. The result is checkpointed: it is short, and most callers read it twice."""
    q = queries.select("query_id", F.explode(terms(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    docs = docs.select("doc_id", "text", *(["source"] if groups is not None else []))
    rows = q.select("query_id", "term", "qtf").limit(MOST_BROADCAST_ROWS + 1).collect()
    if len(rows) > MOST_BROADCAST_ROWS or len({r["query_id"] for r in rows}) > MOST_COLUMNS:
        return checkpointed(ranked(_scored_rows(docs, q, groups), k))
    return checkpointed(ranked(_scored(docs, q, rows, k, groups), k))


def _scored_rows(docs: DataFrame, q: DataFrame, groups: DataFrame | None) -> DataFrame:
    """query_id, doc_id, score of all texts that share a term with a query, by joins of rows."""
    asked = q.select("term").distinct()
    few = asked.count() <= MOST_BROADCAST_ROWS
    kept = ["source"] if groups is not None else []
    tf = postings(docs, asked, few, *kept)
    text = F.col("term") == TEXT
    # Both read the counts as a whole, so that they share one shuffle.
    stats = tf.filter(text).agg(F.sum("tf").alias("n_docs"), F.greatest(F.sum(F.col("length") * F.col("tf")).cast("double") / F.sum("tf"), F.lit(1.0)).alias("avg_length"))
    df = tf.filter(~text).groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weighted = tf.filter(~text).join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))
    weight = (idf * F.col("tf") * (K1 + 1) / norm).cast("decimal(20,12)")
    scores = weighted.select("term", "doc_id", *kept, weight.alias("w"))
    if groups is None:
        hits = scores.join(q, "term")
    else:
        limited = limits(docs, groups)
        free = q.join(limited.select("query_id").distinct(), "query_id", "left_anti")
        own = q.join(limited, "query_id")
        hits = scores.join(free, "term").drop("source").unionByName(scores.join(own, ["term", "source"]).drop("source"))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qtf").cast("decimal(7,0)")).cast("decimal(18,6)").alias("score"))


class Vocabulary:
    """The terms asked for, and the words that they are made of. A pair of words is the term that their joining gives,
    which may be a word as well, as words may have underscores: places in a text are compared as strings, by number."""

    def __init__(self, asked: list[str]):
        number = {t: n for n, t in enumerate(asked)}
        split = [(t[:i], t[i + 1 :], n) for t, n in number.items() for i, c in enumerate(t) if c == "_" and 0 < i < len(t) - 1]
        known = list(dict.fromkeys([*asked, *(left for left, _, _ in split), *(right for _, right, _ in split)]))
        place = {w: n for n, w in enumerate(known)}
        self.n, self.size = len(asked), len(known)
        self.words = pa.array(known, pa.large_string())
        self.term = np.array([number.get(w, -1) for w in known], np.int64)
        codes = np.array([place[left] * self.size + place[right] for left, right, _ in split], np.int64)
        order = np.argsort(codes)
        self.pairs, self.pair_term = codes[order], np.array([n for _, _, n in split], np.int64)[order]

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's number of words; and text, term and count of what it holds, in order of text and term."""
        found, first = words_of(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        word = pc.index_in(found, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.where(word >= 0, self.term[word], -1) if self.size else word
        single = text[code >= 0] * self.n + code[code >= 0]
        both = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0) & (text[:-1] == text[1:])) if len(self.pairs) else np.empty(0, np.int64)
        pair = word[both] * self.size + word[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        met = self.pairs[at] == pair if len(self.pairs) else np.empty(0, bool)
        joined = text[both[met]] * self.n + self.pair_term[at[met]]
        codes, counts = np.unique(np.concatenate([single, joined]), return_counts=True)
        return np.diff(first), codes // max(self.n, 1), codes % max(self.n, 1), counts


def cut(docs: DataFrame, asked: list[str]) -> DataFrame:
    """docs without text, with length, and the numbers of the terms asked for that the text holds, and how often. One row
    for each row."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]
    vocabulary = Vocabulary(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, text, term, count = vocabulary.counted(batch.column("text"))
            places = pa.array(np.searchsorted(text, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(places, pa.array(x, pa.int32())) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.maximum(2 * n_words - 1, 0), pa.int64()), *lists], [*kept, "length", "terms", "tfs"])

    schema = StructType([docs.schema[c] for c in kept] + [StructField("length", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))])
    return spread(docs.select(*kept, "text")).mapInArrow(run, schema)


def _scored(docs: DataFrame, q: DataFrame, rows: list, k: int, groups: DataFrame | None) -> DataFrame:
    """query_id, doc_id, score of at least the k best texts of each query, for queries that a task can hold."""
    spark = docs.sparkSession
    ids, asked = list(dict.fromkeys(r["query_id"] for r in rows)), sorted({r["term"] for r in rows})
    held = checkpointed(cut(docs, asked))
    seen = held.agg(F.count("*").alias("n"), F.sum("length").alias("words")).first()
    # Texts of the same doc_id and length count as one text of a term, whose counts add up.
    again = held.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    repeated = None
    if not again.isEmpty():
        same = held["doc_id"].eqNullSafe(again["doc_id"])
        own = [c for c in held.columns if c not in ("terms", "tfs")]
        each = held.join(again, same, "left_semi").select(*own, F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(*own, "x.terms").agg(F.sum("x.tfs").cast("int").alias("tfs"))
        each = each.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("terms", "tfs"))).alias("x")).select(*own, F.col("x.terms").alias("terms"), F.col("x.tfs").alias("tfs"))
        held, repeated = held.join(again, same, "left_anti"), checkpointed(each)
    every = held if repeated is None else held.select("terms").unionByName(repeated.select("terms"))
    df = every.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = np.zeros(len(asked))
    for r in df.select("term", F.ln(1 + (F.lit(seen["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).collect():
        idf[r["term"]] = r["idf"]
    column, number = {x: n for n, x in enumerate(ids)}, {t: n for n, t in enumerate(asked)}
    most = np.zeros(len(ids))
    for r in rows:
        most[column[r["query_id"]]] += r["qtf"] * idf[number[r["term"]]] * (K1 + 1)
    if len(ids) and most.max() * UNIT > 2**62:
        return _scored_rows(docs, q, groups)  # Such sums are beyond a long.
    index = Postings([(number[r["term"]], column[r["query_id"]], r["qtf"]) for r in rows], idf, max(float(seen["words"] or 0) / max(seen["n"], 1), 1.0))
    allowed = Allowed(ids, limits(docs, groups).collect() if groups is not None else [])
    names = spark.createDataFrame([(n, x) for n, x in enumerate(ids)], StructType([StructField("_column", IntegerType()), StructField("query_id", q.schema["query_id"].dataType)]))

    def scores(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
        for at, n, total in index.totals(batch, len(ids)):
            part = batch.slice(at, n)
            yield (total if allowed.none else np.where(allowed.of(part.column("source")), total, 0)), part.column("doc_id")

    kept = ["doc_id", "length", "terms", "tfs", *(["source"] if groups is not None else [])]
    best = best_of(held.select(*kept), scores, len(ids), k, 0, 10**6)
    out = best.select("_column", "doc_id", "score")
    if repeated is not None:
        all_of = best_of(repeated.select(*kept), scores, len(ids), None, 0, 1)
        summed = all_of.groupBy("_column", "doc_id").agg(F.sum(F.col("score").cast("decimal(38,0)")).alias("s"))
        out = out.unionByName(summed.select("_column", "doc_id", F.floor((F.col("s") + 500_000) / 1_000_000).cast("long").alias("score")))
    return out.join(F.broadcast(names), "_column").select("query_id", "doc_id", as_score(F.col("score")).alias("score"))


def as_score(millionths: Column) -> Column:
    return (millionths.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")


class Postings:
    """The queries' terms, as lists of query and weight by term, for texts as cut() gives them."""

    def __init__(self, entries: list[tuple[int, int, int]], idf: np.ndarray, avg_length: float):
        rows = np.array(sorted(entries), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(rows[:, 0], np.arange(len(idf) + 1))
        self.query, self.times, self.idf, self.avg_length = rows[:, 1], rows[:, 2], idf, avg_length

    def totals(self, batch: pa.RecordBatch, n_queries: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """first, how many, scores of these texts (texts x queries, in UNIT): 0 where a text has no term of a query, as
        every weight is more than nothing."""
        lists, counts = batch.column("terms"), batch.column("tfs")
        n_terms = np.diff(np.asarray(lists.offsets, np.int64))
        term, tf = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        text = np.repeat(np.arange(len(batch)), n_terms)
        length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.float64)[text]
        weight = np.rint(self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.avg_length)) * UNIT).astype(np.int64)
        wide = self.first[term + 1] - self.first[term]
        met = np.r_[0, np.cumsum(np.bincount(text, wide, len(batch)).astype(np.int64))]
        tops = np.r_[0, np.cumsum(n_terms)]
        at = 0
        while at < len(batch):
            n = max(1, min(CELLS // max(n_queries, 1), int(np.searchsorted(met, met[at] + CELLS, "right")) - 1 - at, len(batch) - at))
            some = slice(tops[at], tops[at + n])
            reps, starts = wide[some], self.first[term[some]]
            ends = np.cumsum(reps)
            entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - reps), reps)
            cell = np.repeat(text[some] - at, reps) * n_queries + self.query[entry]
            value = np.repeat(weight[some], reps) * self.times[entry]
            # Sums of doubles are exact below 2^53, so each half of the bits is summed apart.
            high, low = (np.bincount(cell, half, n * n_queries).astype(np.int64) for half in (value >> HALF, value & ((1 << HALF) - 1)))
            yield at, n, ((high << HALF) + low).reshape(n, n_queries)
            at += n


class Allowed:
    """Which queries look at texts of which group; limited: rows of query_id and source, none for a query that is free."""

    def __init__(self, ids: list, limited: list):
        column = {x: n for n, x in enumerate(ids)}
        limited = [(column[r["query_id"]], r["source"]) for r in limited if r["query_id"] in column]
        sources = list(dict.fromkeys(s for _, s in limited))
        self.none, self.sources = not limited, pa.array(sources, pa.string())
        free = np.ones(len(ids), bool)
        free[[c for c, _ in limited]] = False
        # The last row is that of all other groups.
        self.table = np.tile(free, (len(sources) + 1, 1))
        for c, s in limited:
            self.table[sources.index(s), c] = True

    def of(self, source: pa.Array) -> np.ndarray:
        return self.table[pc.index_in(source.cast(pa.string()), value_set=self.sources).fill_null(len(self.sources)).to_numpy(zero_copy_only=False)]


class Best:
    """The k best texts of each query so far, by score and then by the smaller doc_id; or all that score, without k."""

    def __init__(self, n_queries: int, k: int | None, least: int, ids: pa.DataType):
        self.k, self.floor = k, np.full(n_queries, least, np.int64)
        self.most = 100_000 + 4 * (k or 0) * n_queries
        self.parts, self.n = [pa.table({"c": pa.array([], pa.int32()), "s": pa.array([], pa.int64()), "d": pa.array([], ids)})], 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        if self.k is not None and len(scores) > self.k:
            at = len(scores) - self.k
            self.floor = np.maximum(self.floor, np.partition(scores, at, axis=0)[at])
        row, column = np.nonzero(scores >= self.floor)
        self.parts.append(pa.table({"c": pa.array(column, pa.int32()), "s": pa.array(scores[row, column]), "d": ids.take(pa.array(row))}))
        self.n += len(row)
        if self.k is not None and self.n > self.most:
            self.parts = [self.table()]
            self.n = len(self.parts[0])
            self.most = max(self.most, 2 * self.n)

    def table(self) -> pa.Table:
        found = pa.concat_tables(self.parts)
        if self.k is None or not len(found):
            return found
        found = found.take(pc.sort_indices(found, [("c", "ascending"), ("s", "descending"), ("d", "ascending")], null_placement="at_start"))
        c = found["c"].to_numpy()
        tops = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        return found.filter(pa.array(np.arange(len(c)) - np.repeat(tops, np.diff(np.r_[tops, len(c)])) < self.k))


def best_of(rows: DataFrame, scores: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, pa.Array]]], n_queries: int, k: int | None, least: int, unit: int) -> DataFrame:
    """_column, doc_id, score of each task's k best rows of each query, or of all, as scores() gives them for some rows at a
    time: whole numbers over `least`, rounded to multiples of `unit` and divided by it."""
    small_batches(rows.sparkSession)
    schema = StructType([StructField("_column", IntegerType()), rows.schema["doc_id"], StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            best = best or Best(n_queries, k, 0, batch.schema.field("doc_id").type)
            for values, ids in scores(batch):
                best.add(np.where(values > least, (values + unit // 2) // unit, -1), ids)
                if k is None:
                    yield from _sent(best.table())
                    best = Best(n_queries, k, 0, ids.type)
        if best is not None:
            yield from _sent(best.table())

    return rows.mapInArrow(run, schema)


def _sent(found: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from found.select(["c", "d", "s"]).rename_columns(["_column", "doc_id", "score"]).combine_chunks().to_batches(max_chunksize=10_000)


def sent(df: DataFrame) -> DataFrame:
    """df, broadcast where it is short: what it is joined with, texts mostly, is then not shuffled."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS else df


def limits(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """query_id, source: a query's groups; those of a query go if no document is in any of them."""
    there = docs.select("source").distinct()
    met = groups.join(there, "source", "left_semi").select("query_id").distinct()
    return groups.select("query_id", "source").distinct().join(met, "query_id", "left_semi")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def dense(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, groups: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: cosine similarity clamped to [0, 1] (0 for vectors without length), all candidates scored.

    vectors: doc_id, vector, with groups also source. queries: query_id, vector: a stated set, sent to every task in
    batches of VECTOR_BATCH. groups: as for bm25; a vector of another group doesn't count. Checkpointed, as bm25's."""
    spark = vectors.sparkSession
    limited = limits(vectors, groups) if groups is not None else None
    v = spread(vectors.select("doc_id", "vector", *(["source"] if groups is not None else [])))
    q = queries.select("query_id", "vector")
    batches = max(1, -(-q.count() // VECTOR_BATCH))
    q = checkpointed(q) if batches > 1 else q
    out = None
    for n in range(batches):
        rows = (q.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == n) if batches > 1 else q).collect()
        ids = [r["query_id"] for r in rows]
        own = limited.join(F.broadcast(q.select("query_id").filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == n)), "query_id", "left_semi").collect() if limited is not None else []
        schema = StructType([StructField("_column", IntegerType()), StructField("query_id", q.schema["query_id"].dataType)])
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], schema)
        best = best_of(v, _cosines([r["vector"] for r in rows], Allowed(ids, own)), len(ids), k, -1, 1)
        part = best.join(F.broadcast(names), "_column").select("query_id", "doc_id", as_score(F.col("score")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return checkpointed(ranked(out, k))


def _cosines(asked: list, allowed: Allowed) -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, pa.Array]]]:
    """Scores in millionths of a batch's vectors for all queries; -1 where a query doesn't look at a vector's group.
    Vectors that are null, have nulls, or aren't as long as a query's score 0."""
    whole = [n for n, v in enumerate(asked) if v is not None and None not in v]
    columns = {size: [n for n in whole if len(asked[n]) == size] for size in {len(asked[n]) for n in whole} - {0}}
    sides = {size: np.array([asked[n] for n in mine], np.float64) for size, mine in columns.items()}

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", x, x))

    def scores(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
        for at in range(0, len(batch), step := max(1, CELLS // max(len(asked), 1))):
            part = batch.slice(at, step)
            lists = part.column("vector")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            ends = np.cumsum(sizes)
            bad = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
            holed = np.isin(np.arange(len(part)), np.searchsorted(ends, bad, "right"))
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            total = np.zeros((len(part), len(asked)), np.int64)
            for size, mine in columns.items():
                rows = np.flatnonzero((sizes == size) & ~holed)
                x = values[(ends[rows] - size)[:, None] + np.arange(size)]
                with np.errstate(all="ignore"):
                    over = lengths(x)[:, None] * lengths(sides[size])[None, :]
                    cosine = np.where(over == 0, 0.0, (x @ sides[size].T) / over)
                # NaN counts as the largest number, as it does in Spark.
                bounded = np.clip(np.where(np.isnan(cosine), 1.0, cosine), 0.0, 1.0)
                total[np.ix_(rows, mine)] = np.floor(bounded * 1e6 + 0.5).astype(np.int64)
            yield (total if allowed.none else np.where(allowed.of(part.column("source")), total, -1)), part.column("doc_id")

    return scores


def min_max(score: Column, by: str = "query_id") -> Column:
    """Scores within a query's results on [0, 1]; 1 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(F.abs(high - low) <= F.greatest(F.abs(high), F.abs(low)) * 1e-9, 1.0).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def candidates(dense_hits: DataFrame, bm25_hits: DataFrame) -> DataFrame:
    """query_id, doc_id, vector_rank, bm25_rank, vector_score, bm25_score, base: both candidate lists by weight, with a
    bonus for being in both."""
    side = lambda df, p: df.select("query_id", "doc_id", F.col("rank").alias(f"{p}_rank"), F.col("score").alias(f"{p}_score"), min_max(F.col("score").cast("double")).alias(f"{p}_norm"))
    both = side(dense_hits, "vector").join(side(bm25_hits, "bm25"), ["query_id", "doc_id"], "full")
    bonus = F.when(F.col("vector_rank").isNotNull() & F.col("bm25_rank").isNotNull(), BOTH_BONUS).otherwise(0.0)
    base = VECTOR_WEIGHT * F.coalesce("vector_norm", F.lit(0.0)) + BM25_WEIGHT * F.coalesce("bm25_norm", F.lit(0.0)) + bonus
    return both.select("query_id", "doc_id", "vector_rank", "bm25_rank", "vector_score", "bm25_score", base.alias("base"))


def fused(dense_hits: DataFrame, bm25_hits: DataFrame, k: int = FINAL, bonus: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score, vector_rank, bm25_rank: the best of both candidate lists. bonus: query_id, doc_id,
    bonus of candidates, added before they are ranked."""
    both = candidates(dense_hits, bm25_hits)
    if bonus is not None:
        both = both.join(bonus, ["query_id", "doc_id"], "left").withColumn("base", F.col("base") + F.coalesce(F.col("bonus").cast("double"), F.lit(0.0)))
    scored = both.withColumn("score", F.col("base").cast("decimal(18,6)"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score", "vector_rank", "bm25_rank")


def neighbours(chunks: DataFrame, tops: DataFrame, reach: int = 2) -> DataFrame:
    """Chunks within `reach` places of a top chunk of the same document. chunks: document, place, text. tops: query_id, document, top."""
    c, t = chunks.alias("c"), tops.alias("t")
    near = (F.col("c.document") == F.col("t.document")) & (F.abs(F.col("c.place") - F.col("t.top")) <= reach)
    return c.join(t, near).select("t.query_id", "c.document", "c.place", "c.text")


def within_budget(rows: DataFrame, by: str, order: str, text: str, chars: int = 5200, most: int = 4, fingerprint: int = 250) -> DataFrame:
    """by, kept array<order>: the first texts, without repeats, that fit a budget of characters. One too long is skipped, later ones may fit.

    A query's candidates are few (neighbours of its top chunks), so they meet in one array."""
    item = F.struct(F.col(order).alias("o"), F.length(text).cast("long").alias("n"), F.left(F.col(text), F.lit(fingerprint)).alias("f"))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("x"))
    start = F.expr("named_struct('used', 0L, 'seen', cast(array() as array<string>), 'kept', cast(array() as array<bigint>))")

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["n"] <= chars) & (F.size(acc["kept"]) < most) & ~F.array_contains(acc["seen"], x["f"])
        took = F.struct((acc["used"] + x["n"]).alias("used"), F.array_append(acc["seen"], x["f"]).alias("seen"), F.array_append(acc["kept"], x["o"].cast("long")).alias("kept"))
        return F.when(fits, took).otherwise(acc)

    return lists.select(by, F.aggregate("x", start, step, lambda acc: acc["kept"]).alias("kept"))
