import hashlib

import numpy as np
from pyspark.sql import functions as F

from tradewind.llm import mixing


def cells(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")


def test_raking_meets_marginals(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1, 500)), 3) for i in range(5) for j in range(3) for k in range(2)]
    table = {r[:3]: r[3] for r in rows}
    want = {"source": dict(zip([f"s{i}" for i in range(5)], [0.4, 0.3, 0.1, 0.1, 0.1])), "lang": {"l0": 0.5, "l1": 0.25, "l2": 0.25}, "topic": {"t0": 0.5, "t1": 0.5}}
    targets = {a: spark.createDataFrame(list(v.items()), "value string, share double") for a, v in want.items()}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.raked(cells(spark, rows), targets, rounds=25, tolerance=1e-9).collect()}
    w = {k: v / sum(table.values()) for k, v in table.items()}
    for _ in range(25):  # brute force
        for axis, name in enumerate(mixing.ATTRIBUTES):
            sums = {}
            for k, v in w.items():
                sums[k[axis]] = sums.get(k[axis], 0) + v
            w = {k: v * want[name][k[axis]] / sums[k[axis]] for k, v in w.items()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in w.items())
    for axis, name in enumerate(mixing.ATTRIBUTES):
        for value, share in want[name].items():
            assert abs(sum(v for k, v in got.items() if k[axis] == value) - share) < 1e-6


def test_sample_is_the_brute_force_one(spark):
    rows = [(i, "word " * (1 + i % 7), ["en", "de", None][i % 3], f"s{(i * i) % 5}" if i % 4 else "hot", 9, "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate string")
    mixed = mixing.mix(docs, budget=0.5)
    assert mixed.columns[: len(docs.columns)] != [] and set(docs.columns) <= set(mixed.columns)
    out = mixed.collect()
    assert len({r.doc_id for r in out}) == len(out)
    rates = {(r.mix_source, r.mix_lang): r.mix_rate for r in out}
    for i, _, lang, source, _, _ in rows:
        rate = rates.get((source, lang or "unknown"))
        u = int(hashlib.sha256(f"mix{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert rate is None or (u < rate) == (i in {r.doc_id for r in out})
        if i > 300:
            break
    total = sum(1 + i % 7 for i in range(3000))
    assert abs(sum(r.mix_tokens for r in out) / total - 0.5) < 0.05


def test_nulls_ties_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string"
    got = mixing.mix(spark.createDataFrame([(None, None, None, None), (1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, "", None, "s")], schema), budget=1.0)
    assert sorted((r.doc_id or 0, r.mix_tokens, r.mix_lang) for r in got.collect()) == [(0, 0, "unknown"), (1, 2, "en"), (1, 2, "en"), (2, 0, "unknown")]
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a b", "en", "s")], schema), budget=2.5, most=3.0).first().mix_copies in (2, 3)


def test_topics(spark):
    df = spark.createDataFrame([("a | b",), ("x*** y",), ("X!! Y",), ("All rights reserved. x",), ("words",), (" ",)], "t string")
    assert [r[0] for r in df.select(mixing.topic(F.col("t"))).collect()] == ["table", "markup", "shouted", "notice", "prose", "empty"]


def test_notice_anywhere_in_a_text(spark):
    texts = ["word " * 500 + end for end in ("All Rights Reserved", "see the LICENCE", "(c) copyright x", "the end")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.topic(F.col("t"))).collect()] == ["notice", "notice", "notice", "prose"]


def test_targets_are_met_under_the_cap(spark):
    """A cell that can't give its raked share is cut, and the others are raked again: all marginals still hold."""
    docs = {("a", "en"): 200, ("a", "de"): 200, ("b", "en"): 150, ("b", "de"): 10}
    rows = [(f"{s}{lang}{i}", "one two three", lang, s) for (s, lang), n in docs.items() for i in range(n)]
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 1.0}}
    targets = {a: spark.createDataFrame(list(v.items()), "value string, share double") for a, v in want.items()}
    out = mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string"), targets, budget=0.5).collect()
    rates = {(r.mix_source, r.mix_lang): r.mix_rate for r in out}
    assert rates.keys() == docs.keys() and abs(rates["b", "de"] - 1) < 1e-6
    for axis, name in enumerate(("source", "lang")):
        for value, share in want[name].items():
            assert abs(sum(rates[k] * n for k, n in docs.items() if k[axis] == value) / 280 - share) < 1e-4


def test_clashing_and_missing_columns(spark):
    rows = [(i, f"word {i}", "a", 0.5, "b", 7) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mix_rate string, rate double, mix_source string, mix_copies long")
    out = mixing.mix(docs, budget=0.5)
    assert out.columns == ["doc_id", "text", "rate", *mixing.ADDED] and {r.mix_source for r in out.collect()} == {"unknown"}
    own = mixing.sampled(docs, budget=0.5)
    assert own.columns == docs.columns and sorted(tuple(r) for r in own.collect()) == [r for r in rows if r[0] in {x.doc_id for x in out.collect()}]


def test_marginals_tell_what_cannot_be_met(spark):
    rows = [(i, "one two three four", "en", "s", "x") for i in range(90)] + [(100 + i, "a | b", "de", "t", "x") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    rated, targets = mixing.rated_cells(docs, budget=0.9)
    got = {(r.attribute, r.value): (r.wanted, r.got) for r in mixing.marginals(rated, targets).collect()}
    cells = {(r.source, r.lang, r.topic): (r.tokens, r.rate) for r in rated.collect()}
    total = sum(n * rate for n, rate in cells.values())
    for axis, name in enumerate(mixing.ATTRIBUTES):
        for value in {k[axis] for k in cells}:
            assert abs(got[name, value][1] - sum(n * rate for k, (n, rate) in cells.items() if k[axis] == value) / total) < 1e-9
    # The few tokens of "t" can't make up a quarter: the miss shows.
    assert got["source", "t"][0] > 2 * got["source", "t"][1] and abs(total / sum(n for n, _ in cells.values()) - 0.9) < 1e-6
