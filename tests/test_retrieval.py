"""BM25 and dense scores: odd rows, both ways of scoring, and what is shuffled."""

import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradewind.functions import text, words
from tradewind.operators import heuristics, retrieval
from tradewind.plans import more

WORDS = ["phí", "a_b", "a", "b", "c", "b_c", "api", "Ünder", "x/y", "12%", "é", "long-word", "la", "de"]


def texts(rng, n, most=12):
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, most))) for _ in range(n)]


def tables(spark, ids, seed=5):
    rng = random.Random(seed)
    docs = spark.createDataFrame([(i, t if t else None, rng.choice(["s1", "s2", None])) for i, t in zip(ids, texts(rng, len(ids)), strict=True)], "doc_id long, text string, source string").repartition(3)
    return docs, spark.createDataFrame(list(enumerate(texts(rng, 12, 6))), "query_id long, question string")


def found(df):
    return sorted((r.query_id, r["rank"], r.doc_id, str(r.score)) for r in df.collect())


def test_words_of_every_character(spark):
    rows = [(c, f"a{chr(c)}b x{chr(c)} {chr(c)}") for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [(0x20000 + i, t) for i, t in enumerate((None, "", "  ", "ab", "cd "))]
    df = spark.createDataFrame(rows, "id long, text string").select("text", text.unigrams(F.col("text")).alias("w")).toArrow()
    got, first = words.words(df["text"].combine_chunks())
    got = got.to_pylist()
    assert [got[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == df["w"].to_pylist()
    assert words.words(pa.array([], pa.string()))[0].to_pylist() == []


@pytest.mark.parametrize("ids", [list(range(200)), [i % 70 for i in range(200)], [1] * 20])
def test_repeated_ids_as_in_sql(spark, ids):
    docs, queries = tables(spark, ids)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", queries.select(F.col("query_id").alias("item_id"), F.col("question").alias("text")).toArrow())
    want = sorted((q, r, d, str(s)) for q, r, d, s in con.sql(f"SELECT query_id, rank, doc_id, score FROM ({more.ORACLES['ret01_bm25']}) z").fetchall())
    assert found(retrieval.bm25(docs.select("doc_id", "text"), queries)) == want and want


@pytest.mark.parametrize("ids", [list(range(150)), [i % 50 for i in range(150)]])
def test_rows_and_columns_score_alike(spark, monkeypatch, ids):
    docs, queries = tables(spark, ids, 6)
    groups = spark.createDataFrame([(0, "s1"), (1, "s1"), (1, "s2"), (2, "none"), (3, "s2"), (3, "none")], "query_id long, source string")
    for limited in (None, groups):
        one = found(retrieval.bm25(docs, queries, 4, limited))
        for name, most in (("CELLS", 50), ("MOST_BROADCAST_ROWS", 5), ("MOST_COLUMNS", 3)):
            with monkeypatch.context() as m:
                m.setattr(retrieval, name, most)
                assert found(retrieval.bm25(docs, queries, 4, limited)) == one
        assert one and all(n <= 4 for _, n, _, _ in one)


def test_no_texts_and_no_words(spark):
    docs, queries = tables(spark, list(range(5)))
    assert found(retrieval.bm25(docs.limit(0), queries)) == [] and found(retrieval.bm25(docs, queries.limit(0))) == []
    assert found(retrieval.bm25(docs.withColumn("text", F.lit("!")), queries)) == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-3.0, -4.0]), (9, []), (10, [4.0, 3.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(1, [6.0, 8.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query_id long, vector array<float>")
    v, q = vectors.alias("v"), queries.alias("q")
    cosine = F.coalesce(F.try_divide(retrieval.dot(F.col("v.vector"), F.col("q.vector")), retrieval.length(F.col("v.vector")) * retrieval.length(F.col("q.vector"))), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)).cast("decimal(18,6)")
    want = found(retrieval.ranked(v.crossJoin(q).select("query_id", "doc_id", score.alias("score")), 4))
    assert found(retrieval.dense(vectors, queries, 4)) == want and len(want) == 16


@pytest.fixture
def shuffled(spark):
    """Bytes in shuffle files that came since the test began."""
    folders = [Path(p) for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f: f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data")}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    old = set(files())
    yield lambda: sum(n for f, n in files().items() if f not in old)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_texts_and_postings_are_not_shuffled(spark, shuffled):
    rng = random.Random(7)
    some = [rng.randbytes(3).hex() for _ in range(400)]
    rows = [(i, " ".join(rng.choices(some, k=300)), "t", "1", "s1", "d") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, page string, source string, document_id string").repartition(4).localCheckpoint()
    queries = spark.createDataFrame([(i, " ".join(rng.choices(some, k=30))) for i in range(20)], "query_id long, question string")
    before = shuffled()
    assert heuristics.search(docs, queries).count() == 60
    assert shuffled() - before < 0.2 * sum(len(r[1]) for r in rows)


def test_token_counts_cut_a_text_once(spark):
    rows = [(1, "Phí phi 12 ab abc a_b"), (2, None), (3, ""), (4, " ! "), (5, "abc"), (6, "123 1234 12a"), (None, "é éé ééé")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = retrieval.token_counts(df)
    w = text.unigrams(F.col("text"))
    want = df.select("doc_id", F.size(w).cast("long"), F.size(retrieval.terms(F.col("text"))).cast("long"), F.size(text.token_set(F.col("text"))).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in want.toDF(*got.columns).collect())
    assert "translate" not in more.QUERIES["str03_token_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
