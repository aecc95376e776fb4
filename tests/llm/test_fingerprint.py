import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tradewind.llm import fingerprint as fp


def edited(rows):
    out = []
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        out.append((i, t[: len(t) - q] + nxt[:q]))
    return dict(out)


def test_edited_texts_and_likeness(spark):
    words = [f"w{i}é" for i in range(400)]
    rows = [(3 * i, " ".join(words[i : i + 60]) + "\n" + " ".join(words[i + 200 : i + 260])) for i in range(40)] + [(1, ""), (2, "🙂a"), (200, "x y z " * 30_000), (4, "one")]
    df = spark.createDataFrame([(i, t or None, "clash") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    want = edited(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest(), i
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if 3 <= i < 117 and i % 3 == 0:
            assert 0.55 < r.near_edited < 0.95


def test_likeness_estimates_shared_triples(spark):
    a = [f"a{i}" for i in range(40_000)]
    texts = [" ".join(a), " ".join(a[:30_000]), " ".join(f"b{i}" for i in range(40_000)), " ".join(a[:10])]
    df = fp.of_texts(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), ["k"], "t").toDF("k", "f")
    both = df.alias("x").join(df.alias("y"), F.col("x.k") < F.col("y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), fp.likeness(F.col("x.f"), F.col("y.f")).alias("n"))
    near = {(r.a, r.b): r.n for r in both.collect()}
    assert abs(near[0, 1] - (1 - 10_000 / 70_000)) < 0.06
    assert near[0, 2] < 0.45 and near[0, 3] < 0.45


def test_likeness_of_a_line_repeated_many_times(spark):
    """Counters of much-repeated triples neither wrap nor spoil each other: the estimate follows exact counts."""
    line = [f"w{i}" for i in range(12)]
    for repeats in (1_000, 10_000):
        kept = repeats * 3 // 4
        pair = [[line] * repeats, [line] * kept + [[f"r{i}" for i in range(12 * (repeats - kept))]]]
        counts = []
        for lines in pair:
            c = Counter()
            for w in lines:
                around = ["\n", *w, "\n"]
                c.update(zip(around, around[1:], around[2:]))
            counts.append(c)
        square = lambda c: sum(v * v for v in c.values())
        apart = Counter(counts[0])
        apart.subtract(counts[1])
        want = 1 - square(apart) / sum(map(square, counts))
        texts = [(k, "\n".join(map(" ".join, lines))) for k, lines in enumerate(pair)]
        f = {r.k: r.fingerprint for r in fp.of_texts(spark.createDataFrame(texts, "k long, t string"), ["k"], "t").collect()}
        got = spark.createDataFrame([(f[0], f[1])], "a array<long>, b array<long>").select(fp.likeness(F.col("a"), F.col("b"))).first()[0]
        assert abs(got - want) < 0.03, (repeats, got, want)


def test_order_free_and_incremental(spark):
    df = spark.createDataFrame([(1, "a b c d\ne f\ng h i"), (2, "g h i\na b c d\ne f"), (3, "a b c d\ng h i"), (4, "e f"), (5, "a b c d\nE f\ng h i")], "k long, t string")
    f = {r.k: r.fingerprint for r in fp.of_texts(df, ["k"], "t").collect()}
    assert f[1] == f[2] != f[5]
    one = spark.createDataFrame([(f[1], f[3], f[4])], "a array<long>, b array<long>, c array<long>")
    r = one.select(fp.inserted(F.col("b"), F.col("c")).alias("plus"), fp.deleted(F.col("a"), F.col("c")).alias("minus"), fp.likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert (r.plus, r.minus, r.same) == (f[1], f[3], 1.0)


def test_ties_nulls_and_empty(spark):
    rows = [(1, "abcdefgh"), (1, "abcdefgh"), (5, "zzzzzzzz"), (5, "yyyyyyyy"), (None, "qqqqqqqq")]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in got) == sorted([(1, sha("abcdefyy"))] * 2 + [(5, sha("zzzzzzab")), (5, sha("yyyyyyab")), (0, sha("qqqqqq"))])
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
