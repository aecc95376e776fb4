import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tradewind.llm import ngram_join as nj
from tradewind.llm.components import components


def sets_of(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and c * den >= num * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n_bases=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_bases):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 12, 30, 60, 150, 400]))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 2)
                t = t or ["x"]
            rows.append(" ".join(t))
            base = t if rng.random() < 0.4 else base
    rows += ["", " \n ", None, "one", "ONE", "two three", "two\tthree", "É é", "é é", "long " * 30_000]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 3, 9, 10), (2, 5, 4, 5)])
def test_components_equal_brute_force(spark, seed, k, num, den):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, keys string, n int")
    got = sorted(tuple(r) for r in nj.similarity_components(df, k, num, den).collect())
    assert got == brute(rows, k, num, den)


def test_split_trees(spark, monkeypatch):
    """Blocks of few classes, so that links are found across blocks."""
    monkeypatch.setattr(nj, "BLOCK_CLASSES", 4)
    rows = corpus(7, 5)
    got = sorted(tuple(r) for r in nj.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect())
    assert got == brute(rows, 3, 9, 10)


def test_open_trees_of_repeated_rows(spark, monkeypatch):
    """A tree of as many classes as a block holds, and more rows than that, loses no link across blocks."""
    monkeypatch.setattr(nj, "BLOCK_CLASSES", 40)
    rows = [r for r in corpus(7, 5) for _ in range(4)]
    got = sorted(tuple(r) for r in nj.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect())
    assert got == brute(rows, 3, 9, 10)


def keys_of(sets, num, den):
    keys, owners = nj.tree_keys(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), num, den)
    return [set(keys[owners == i].tolist()) for i in range(len(sets))]


def test_member_sets_equal_the_rule():
    texts = ["", " \n", "one", "ONE two", "a b c d", "a b c d a b c d", "x\x0by\x0cz", "É é É é", "w" * 300_000 + " a b", "a b", "z", "b " + " " * 300_000 + "c d"]
    for k in (3, 5):
        flat, at = nj.member_sets(pa.array(texts).slice(0), k)
        assert np.diff(at).tolist() == [len(sets_of(t, k)) for t in texts]
        alone = [nj.member_sets(pa.array(["pad pad", t]).slice(1), k)[0].tolist() for t in texts]
        assert alone == [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    upper, _ = nj.member_sets(pa.array(["ABC DEF GHI É", "abc def ghi É", "abc def ghi é"]), 3)
    assert upper.tolist()[:2] == upper.tolist()[2:4] != upper.tolist()[4:6]


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    for num, den in ((9, 10), (4, 5)):
        sets = []
        for n in [*range(1, 60), *range(1, 60), *range(1, 60), 100, 333, 2000]:
            h = np.unique(rng.integers(0, 2**64, n, np.uint64))
            apart = nj.most_apart(n, num, den)
            gone = rng.integers(0, apart + 1)
            other = np.unique(np.r_[h[gone:], rng.integers(0, 2**64, apart - gone, np.uint64)])
            c = len(np.intersect1d(h, other))
            if c * den >= num * (len(h) + len(other) - c):
                sets += [h, other]
        keys = keys_of(sets, num, den)
        assert len(sets) > 100 and all(keys[i] & keys[i + 1] for i in range(0, len(keys), 2))


def test_unrelated_sets_share_no_key():
    rng = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5)):
        sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in rng.integers(1, 1500, 600)]
        keys = keys_of(sets, num, den)
        assert len(set().union(*keys)) == sum(map(len, keys))
        # Not many keys either: about three for five members at 4/5, in two bands or so.
        assert sum(map(len, keys)) < sum(map(len, sets)) * (0.65 if den == 5 else 0.4)


def test_fewer_keys_connect_the_same_sets():
    rng = np.random.default_rng(8)
    keys, owners = rng.integers(0, 60, 400).astype(np.uint64), np.sort(rng.integers(0, 120, 400))

    def groups(at):
        root = list(range(120))
        for k in set(keys[at].tolist()):
            here = owners[at][keys[at] == k]
            for o in here:
                root = [root[here[0]] if r == root[o] else r for r in root]
        return [root.index(r) for r in root]

    kept = nj.fewer_keys(keys, owners)
    assert groups(kept) == groups(np.arange(400)) and len(kept) < 400
    # A popular tree leaves one row for each set, however many keys its sets share.
    many = nj.fewer_keys(np.tile(np.arange(100, dtype=np.uint64), 50), np.repeat(np.arange(50), 100))
    assert len(many) == 100 + 49


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**64, 100, np.uint64))
    sets = [np.unique(np.r_[rng.choice(base, 100 - rng.integers(0, 9), replace=False), rng.integers(0, 2**64, rng.integers(0, 5), np.uint64)]) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 2**64, 100, np.uint64)) for _ in range(50)]
    labels = np.arange(200) % 190
    blocks = [nj.Block(np.arange(200)[at], labels[at], sets[at], nj.bitmap_width(6)) for at in (slice(0, 200), slice(0, 90), slice(90, 200))]
    want = set()
    for i in range(200):
        for j in range(i + 1, 200):
            c = len(np.intersect1d(sets[i], sets[j]))
            if c * 10 >= 9 * (len(sets[i]) + len(sets[j]) - c) and labels[i] != labels[j]:
                want.add((i, j))
    pairs = lambda x, y: set(zip(*(b.ids[at].tolist() for b, at in zip((x, y), nj.dual_traversal(x, y, 9, 10), strict=True)), strict=True))
    got = pairs(blocks[0], blocks[0])
    assert want <= got and len(got) < 2 * len(want)
    assert set().union(*(pairs(x, y) for x, y in ((blocks[1], blocks[1]), (blocks[2], blocks[2]), (blocks[1], blocks[2])))) == got
    # Links: a forest that connects the same classes.
    a, b = nj.links(blocks[0], blocks[0], 9, 10)
    assert {frozenset(p) for p in zip(a, b, strict=True)} <= {frozenset((labels[i], labels[j])) for i, j in want} and len(a) < 190
    one, two = nj.Groups(), nj.Groups()
    for i, j in want:
        one.join(int(labels[i]), int(labels[j]))
    for i, j in zip(a, b, strict=True):
        two.join(i, j)
    assert [one.find(i) for i in range(190)] == [two.find(i) for i in range(190)]


def near_copies(rng, n, words=120):
    vocab = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(words)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        yield " ".join(t)


def test_large_groups_leave_few_links(spark, monkeypatch):
    """A group of near copies in many blocks: right components, and fewer links than classes."""
    monkeypatch.setattr(nj, "BLOCK_CLASSES", 32)
    rng = random.Random(3)
    texts = [*near_copies(rng, 220), *(" ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randint(3, 150))) for _ in range(60))] + ["same text in many copies"] * 300
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = list(zip(order, texts, strict=True))
    made = []
    real = nj.components
    monkeypatch.setattr(nj, "components", lambda e: made.append(e.count()) or real(e))
    got = sorted(tuple(r) for r in nj.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect())
    assert got == brute(rows, 3, 9, 10)
    assert made[1] < 2 * 220 and made[-1] < 3 * 220


def test_survivors(spark):
    one, two = "a b c d e f g h i j k l m n o p q r s t", "another text of some words that is long enough to be here"
    rows = [(3, one, 1), (1, one, 2), (1, one, 3), (1, two, 4), (2, two, 5), (7, two + " x", 6), (4, "", 7), (5, None, 8), (5, None, 9), (None, one, 10), (None, one, 11), (6, "alone here", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_n int")
    got = nj.survivors(docs, 5, 4, 5)
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    assert sorted((d or 0, t or "") for d, t, _ in got) == sorted([(1, one), (1, two), (4, ""), (5, ""), (0, one), (0, one), (6, "alone here")])
    assert {k for d, _, k in got if d == 5} <= {8, 9}


def test_components_of_paths_and_stars(spark, monkeypatch):
    from tradewind.llm import components as c

    monkeypatch.setattr(c, "EDGES", 3)
    edges = [(i, i + 1) for i in range(0, 40, 2)] + [(i, i + 1) for i in range(1, 40, 2)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7, "a")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_stars_do_not_grow_with_tasks(spark, monkeypatch):
    """Classes that share many keys come to stars once for each different edge, each class in one task."""
    monkeypatch.setattr(nj, "routes", lambda docs, *_: docs)
    rows = spark.createDataFrame([(key, c) for key in range(40) for c in [key % 3, *range(3, 200)]], "key long, cid long")
    edges = nj.shared_trees(rows, 5, 4, 5, 1)
    assert sorted((r.a, r.b) for r in edges.collect()) == [(a, b) for a in range(3) for b in range(3, 200)]
    assert edges.selectExpr("b", "spark_partition_id() as task").distinct().count() == 197
    assert {(r.node, r.root) for r in components(edges).collect()} == {(v, 0) for v in range(200)}


def test_empty(spark):
    assert nj.similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
