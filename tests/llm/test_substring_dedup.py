import random
import re

import numpy as np
import pyarrow as pa

from tradewind.llm import substring_dedup as sd


def brute(rows, window):
    words = [(i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["É", "é", "\xa0"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 40))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, 50), rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(70, None), (71, ""), (72, " "), (None, " ".join(passages[0])), (80, "a b " * 20_000), (81, "a b " * 20_000), (81, "a b " * 20_000), (3, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, starts int")
    for window in (13, 6):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(df, window).collect())
        assert got == brute(rows, window)


def test_blocks_hold_each_window_once():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 3, 12, 13, 14, 60, 700]))) for _ in range(40)] + ["x " * 500]
    parse = sd.Parse(pa.array(texts), 13)
    assert sd.ranges(parse.blocks, parse.lengths).tolist() == parse.windows.tolist() and parse.lengths.max() <= sd.MOST
    keys, more = parse.block_keys()
    words = [w for t in texts for w in t.split()]
    named = {}
    for k, m, s, n in zip(keys.tolist(), more.tolist(), parse.blocks, parse.lengths, strict=True):
        assert named.setdefault((k, m), words[s : s + n + 12]) == words[s : s + n + 12]
    assert len(named) == len({tuple(w) for w in named.values()})


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(5)
    text = [rng.choice("abcdefghij") for _ in range(3000)]
    parse = sd.Parse(pa.array([" ".join(text), " ".join(["z", *text[500:900]])]), 13)
    g, at = parse.anchors(5)
    assert [at[i] - i for i in range(500, 880)] == [at[i] - i for i in range(3001, 3381)]
    assert all(g[at[i]] >> np.uint64(28) == (g[i : i + 9] >> np.uint64(28)).min() for i in range(0, 2900, 7))


def test_resolved_rows_leave_one_row_of_a_key():
    key = np.array([5, 5, 5, 9, 9, 7], np.uint64)
    doc, at = np.array([3, 1, 2, 4, 4, 1]), np.arange(6)
    known, spread = sd.resolved(key, key, doc, at, both=False)
    assert known.tolist() == [True, False, True, False, False, False] and spread.tolist().count(5) == 1
    known, spread = sd.resolved(key, key, doc, at, both=True)
    assert known.tolist() == [True, True, True, False, False, False] and spread[1] == 5 and spread.tolist().count(5) == 1
    known, _ = sd.resolved(key, np.array([1, 2, 1, 0, 0, 0], np.uint64), doc, at, both=False)
    assert not known.any()


def test_few_rows_at_once(spark, monkeypatch):
    monkeypatch.setattr(sd, "ROWS", 3)
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{line} own{i} {line if i % 3 else ''} end{i}") for i in range(50)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect())
    assert got == brute(rows, 13)


def test_empty(spark):
    assert sd.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
