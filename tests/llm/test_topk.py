import math
import tracemalloc

import numpy as np
import pytest

from tradewind.llm import topk


def brute(rows, k, every):
    v = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = [math.floor(1024 * float(np.float32(c))) for c in x]
        v[i] = min(v.get(i, q), q)
    out = []
    for q in v:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q)
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "batch"), [(64, 16), (8192, 16_384)])
def test_equals_brute_force(spark, monkeypatch, block, batch):
    """Also with small blocks, and with queries in several batches."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "BATCH", batch)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        x = rng.normal(size=24) if i % 5 else np.round(rng.normal(size=24))
        x = (x / max(1e-9, np.linalg.norm(x))).astype(np.float32).tolist()
        rows.append((i, x))
    rows += [(700, None), (800, [None] * 24), (900, [float("nan")] * 24), (1000, [float("inf")] * 24), (1100, [0.0] * 24), (1200, [1.0, 2.0]), (10, rows[3][1]), (7, rows[7][1]), (None, rows[1][1]), (1300, [])]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<float>, v string, rank int").repartition(3)
    assert sorted(tuple(r) for r in topk.search(df, 50, 10).collect()) == brute(rows, 10, 50)


def test_takes_less_work_than_brute_force():
    """Segments are taken once each, and not all of them: fewer multiplications than whole products, with equal results."""
    rng = np.random.default_rng(8)
    x = np.floor(1024 * rng.normal(size=(12_000, 64)) / 8)
    x[:4000] = np.floor(x[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 64)) * 20)
    q, ids = x[:40], np.arange(40)
    state = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q]
    work = 0
    for at in (0, 6000):
        block = topk.Segments.unpacked(topk.Segments(np.arange(at, at + 6000), x[at : at + 6000]).packed())
        work += topk.search_block(block, ids, q, 10, state)
    assert work < 0.85 * x.size * len(q)
    for i, (got, scores) in enumerate(state):
        all_scores = x @ q[i]
        all_scores[i] = -np.inf
        order = np.lexsort((np.arange(len(x)), -all_scores))[:10]
        assert got.tolist() == order.tolist() and scores.tolist() == all_scores[order].tolist()


def test_segments_hold_each_posting_once():
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(300, 12)) * 40)
    s = topk.Segments(np.arange(300), x)
    seen, at = np.zeros_like(x), 0
    for impact, dim, n in zip(s.impacts, s.dims, s.counts, strict=True):
        rows = s.rows[at : at + n]
        seen[rows, dim] += x[rows, dim]
        assert ((np.abs(x[rows, dim]) >= 2.0 ** (impact - 1)) & (np.abs(x[rows, dim]) < 2.0**impact)).all()
        at += n
    assert (seen == x).all() and (np.diff(s.impacts) <= 0).all()


def test_very_large_components(spark):
    """Exact beyond longs; a score that no long holds is its limit, and such scores tie."""
    big = float(np.float32(1e18))
    rows = [(0, [big, 1.0]), (1, [1.0, 0.0]), (2, [-big, 0.5]), (3, [big, 2.0]), (4, [1e-3, 0.0]), (5, [3e38, 0.0]), (6, [0.0, 1.0])]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    whole = {i: [math.floor(1024 * float(np.float32(c))) for c in v] for i, v in rows}
    want = sorted((-min(max(sum(a * b for a, b in zip(whole[0], v)), -(2**63)), 2**63 - 1), i) for i, v in whole.items() if i)
    assert sorted(got) == [(0, r + 1, i, -s) for r, (s, i) in enumerate(want)]
    # Not finite once scaled: no part.
    rows = [(0, [1.0]), (1, [1e307]), (2, [2.0])]
    assert [r.vec_id for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()] == [2]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in topk.search(spark.createDataFrame([(0, [0.5]), (1, [0.25])], schema)).collect()] == [(0, 1, 1, 512 * 256)]


def test_equal_vectors_take_bounded_memory():
    """A whole block of equal vectors against as many queries as are scored together: nothing can be dropped."""
    x = np.ones((topk.BLOCK, 64))
    block = topk.Segments(np.arange(topk.BLOCK), x)
    q_ids = np.arange(topk.TOGETHER) * 100
    state = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
    tracemalloc.start()
    topk.search_block(block, q_ids, np.ones((topk.TOGETHER, 64)), 10, state)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6, peak
    assert all(s[0].tolist() == [i for i in range(12) if i != own][:10] and set(s[1].tolist()) == {64} for own, s in zip(q_ids, state))
