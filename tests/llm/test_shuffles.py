"""What is shuffled, and for how long it lies on disk."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tradewind.llm import ngram_join
from tradewind.llm.common import SHUFFLES_GO, dropped, written


@pytest.fixture
def shuffled(spark):
    """Bytes in shuffle files that came since the test began; Spark may only have deleted older ones meanwhile."""
    folders = [Path(p) for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f: f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data")}
    old = set(files())
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda: sum(n for f, n in files().items() if f not in old)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def noise(rng, n):
    return rng.randbytes(n).hex()


def test_written_tables_leave_no_shuffle(spark, shuffled):
    before = spark.conf.get(SHUFFLES_GO)
    df = spark.range(50_000).select((F.col("id") % 9_973).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    table = written(df.groupBy("k").agg(F.max("s").alias("s")), "shuffle_test")
    assert table.count() == 9_973
    assert spark.conf.get(SHUFFLES_GO) == before
    dropped(table)
    assert shuffled() < 100_000


def test_texts_that_stay_are_not_shuffled(spark, shuffled):
    rng = random.Random(3)
    texts = [" ".join(noise(rng, 4) for _ in range(60)) for _ in range(2_000)]
    rows = [*enumerate(texts), *((5_000 + i, texts[i]) for i in range(100)), (None, texts[0]), (7_000, ""), (7_001, None)]
    out = ngram_join.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint())
    before = shuffled()
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
    assert got == sorted([(True, i) for i in range(2_000)] + [(True, 7_000), (True, 7_001), (False, 0)])
    assert shuffled() - before < 0.3 * sum(map(len, texts))


def test_passes_over_the_keys_find_the_same(spark):
    rng = random.Random(4)
    texts = [[noise(rng, 3) for _ in range(rng.randint(20, 60))] for _ in range(60)]
    near = [[*t[:k], "other", *t[k + 1 :]] for t in texts for k in (0, len(t) - 1)]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts + near))), "doc_id long, text string")
    once, again = (sorted(map(tuple, ngram_join.class_components(docs, passes=p)[1].select("cid", "component").collect())) for p in (1, 3))
    assert once == again and len({c for _, c in once}) < 180
    keys = lambda *part: ngram_join.routes(docs, 5, 4, 5, *part).select("key").distinct()
    parts = [keys(p, 3) for p in range(3)]
    assert all(p.count() for p in parts) and sum(p.count() for p in parts) == keys().count()


def test_blocks_of_a_tree_are_shipped_few_times(spark, shuffled):
    rng = random.Random(5)
    sets = [sorted(rng.getrandbits(63) for _ in range(400)) for _ in range(120)]
    # The classes 0 and 119, and 40 and 81, are linked, across blocks; so are 60 and 61, in one.
    for one, two in ((0, 119), (40, 81), (60, 61)):
        sets[two] = sorted(sets[one][:390] + [rng.getrandbits(63) for _ in range(10)])
    rows = [(1, 8, i // 2, False, i, i, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, octave int, salt long, head boolean, cid long, label long, members array<long>")
    df = df.repartition(4, "salt").sortWithinPartitions("key", "octave", "salt", "cid").localCheckpoint()
    before = shuffled()
    links, _ = ngram_join.across_blocks(df, 4, 5)
    assert sorted(tuple(sorted(r)) for r in links.collect()) == [(0, 119), (40, 81), (60, 61)]
    assert shuffled() - before < 8 * 120 * 400 * 8
