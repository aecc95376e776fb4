import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import quality, toxicity
from tradewind.llm.common import fold


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def toxic_rows(n=600, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["jerkface", "dumbo", "lowlife", "crudbag"]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        y = int(rng.random() < 0.3)
        for _ in range(rng.randint(1, 3) * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", "er"]))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(5000, None, "x", 1.0), (5001, "", "x", 1.0), (3, rows[3][1], "x", 1.0)], "doc_id long, text string, key string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    assert {r.score for r in got if r.doc_id in (5000, 5001)} == {model.score([""])[0]} and model.score([""])[0] < 0.5
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted == 0)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = toxic_rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    as_is = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, 1 - y if held_out(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.fit(docs, y)).collect()) for y in (as_is, flipped)]
    assert scores[0] == scores[1]


def test_label_model_finds_accuracies_and_repetition():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(float)
    fire = lambda a, b: np.where(y == 1, rng.random(4000) < a, rng.random(4000) < b).astype(float)
    one = fire(0.6, 0.05)
    v = np.c_[one, one, fire(0.5, 0.05), fire(0.2, 0.2), fire(0.7, 0.1)]
    v = np.c_[v, v.sum(1) == 0]
    post, rates, weight = toxicity.label_model(v, np.where(rng.random(4000) < 0.9, y, 1 - y))
    assert ((post > 0.5) == y).mean() > 0.8
    assert rates[1, 0] > 0.4 and rates[0, 0] < 0.15
    assert weight[0] < 0.6 < weight[3]


def quality_rows(n=500):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        w = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 120))]
        y = int(rng.random() < 0.6)
        rows.append((i, " ".join(w) if y else rng.choice([" | ".join(w), "!! ".join(w).upper(), " ".join(w[:1] * 60)]), y))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "abc", "x"), (5002, "é | " * 200_000, "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    truth = {i: y for i, _, y in rows}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) + 4 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1
    assert all(0 <= r.score <= 1 for r in got)


def test_gradients_are_right():
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [quality.padded("hello hello | world " * 9), quality.padded("ZZ!! " * 30)]
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])
    _, g = net.gradients(texts, y, w)
    rng = np.random.default_rng(0)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for at in rng.integers(0, flat.size, 4):
            keep, eps = flat[at], 1e-3
            flat[at] = keep + eps
            up, _ = net.gradients(texts, y, w)
            flat[at] = keep - eps
            down, _ = net.gradients(texts, y, w)
            flat[at] = keep
            assert abs((up - down) / (2 * eps) - g[k].reshape(-1)[at]) < 2e-3, k


def test_spans_cover_long_texts(monkeypatch):
    net, text = quality.Network(), "some words and more of them, " * 400
    whole = net.logit(text)
    monkeypatch.setattr(quality, "SPAN", 1024)
    assert abs(net.logit(text) - whole) < 0.05


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_and_empty(spark, module):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.score(docs, module.fit(docs, none)).count() == 1
    assert module.score(docs.limit(0), module.fit(docs, one)).count() == 0


def test_fold(spark):
    rows = spark.range(200).select("id", (fold(F.col("id")) == 0).alias("out")).collect()
    assert all(r.out == held_out(r.id) for r in rows)
