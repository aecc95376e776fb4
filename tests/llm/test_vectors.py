"""The three operators on embeddings against brute force, and their defined results."""

import hashlib
import math

import numpy as np
import pytest

from tradewind.llm import near_vectors, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def table(spark, rows, parts=3):
    """rows: vec_id, vector, label; with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA).repartition(parts)


def odd_rows(v):
    return [(700, None, 1), (701, [None] * len(v), 1), (702, [float("nan")] + v[1:], 2), (703, [float("inf")] + v[1:], None)]


def clustered(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


# --- vector codes


def kmeans(rows, entries=256, rounds=4):
    """The contract by brute force in Python's integers: [(vec_id, code, error)], the codebooks, and labels' errors."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = 4 * max(1, math.ceil(max(len(v) for _, v, _ in kept) / 4))
    kept = [(i, v + [0] * (width - len(v)), y) for i, v, y in kept]
    part = width // 4
    cut = lambda v, p: v[p * part : (p + 1) * part]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in order] for p in range(4)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((distance(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[nearest(v, p)[1] for p in range(4)] for _, v, _ in kept]
        for p in range(4):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    out, by_label = [], {}
    for i, v, y in kept:
        best = [nearest(v, p) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), y))
        by_label[y] = by_label.get(y, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[y], digest) for i, c, e, y in out), key=repr)


@pytest.mark.parametrize("case", ["clusters", "ties", "few", "large", "uneven"])
def test_codes_equal_brute_force(spark, case, monkeypatch):
    """Also with repeated rows, equal distances, fewer rows than entries, components beyond doubles, and other lengths."""
    monkeypatch.setattr(vector_codes, "ENTRIES", 16 if case in ("clusters", "ties") else 256)
    monkeypatch.setattr(vector_codes, "LISTED", 6)
    if case == "clusters":
        rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(clustered(400, 16, 1))] + odd_rows([0.5] * 16)
        rows += [(5, rows[9][1], 1), (None, rows[3][1], 0), (800, rows[20][1], 2)]
    elif case == "ties":
        rng = np.random.default_rng(2)
        rows = [(i, (rng.integers(-2, 3, 8) / 4).astype(np.float32).tolist(), i % 2) for i in range(300)] + [(900 + i, [0.25] * 8, None) for i in range(150)]
    elif case == "few":
        rows = [(i, v, 0) for i, v in enumerate(clustered(5, 8, 3))] + odd_rows([0.5] * 8)
    elif case == "large":
        rows = [(i, (np.array(v) * 10.0 ** (i % 13)).astype(np.float32).tolist(), 1) for i, v in enumerate(clustered(60, 8, 4))]
    else:
        rows = [(0, [0.5, 0.25, 0.1], 1), (1, [0.5, -0.25, 0.1, 0.3, 0.9], 1), (2, [], None), (3, [0.7], None)]
    want = kmeans([(i, v, y) for i, v, y in rows], vector_codes.ENTRIES)
    assert sorted((tuple(r) for r in vector_codes.codes(table(spark, rows)).collect()), key=repr) == want


def test_codes_of_one_row_and_of_none(spark):
    one = vector_codes.codes(table(spark, [(4, [0.5, -0.5, 0.25, 1.0], None)])).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(4, "00000000", 0, 0)]
    assert vector_codes.codes(table(spark, odd_rows([0.5] * 4))).collect() == []
    assert vector_codes.codes(table(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_spare_distances():
    """After the first round most parts keep their entry by bounds alone, and the results are those of all distances."""
    rng = np.random.default_rng(5)
    x = np.floor(1024 * (rng.normal(size=(32, 16))[rng.integers(0, 32, 3000)] + 0.05 * rng.normal(size=(3000, 16)))).astype(np.int64)
    entries = x[:32].copy()
    state, _ = vector_codes.assign(x, entries, vector_codes.State.of(len(x), 8), np.zeros(32), 8)
    shares = []
    for _ in range(4):
        new = np.array([x[state.code == k].sum(0) // max(1, (state.code == k).sum()) if (state.code == k).any() else entries[k] for k in range(32)])
        moved = np.sqrt(((new - entries) ** 2).sum(1)) * (1 + vector_codes.SLACK)
        entries = new
        state, looked = vector_codes.assign(x, entries, state, moved, 6)
        assert (state.code == vector_codes.squared(x, entries).argmin(1)).all()
        shares.append((looked == 0).mean())
    assert shares[-1] > 0.8


# --- whitening


def brute_whitening(rows):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(v) for v in {tuple(v) for _, v in kept}]
    n, d = len(fit), len(fit[0])
    s = [sum(col) for col in zip(*fit)]
    v = np.array([[(n * sum(a * b for a, b in zip(x, y)) - sum(x) * sum(y)) / n**2 for y in zip(*fit)] for x in zip(*fit)]).reshape(d, d)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return {(i, tuple(x)): (n, sum((n * c - t) ** 2 for c, t in zip(x, s)), (np.array([(n * c - t) / n for c, t in zip(x, s)]) @ axes / np.sqrt(np.maximum(e, 1e-300))), e / e.sum()) for i, x in kept}


def test_whitening_equals_brute_force(spark):
    rows = [(i, v, 0) for i, v in enumerate(clustered(500, 12, 6))] + odd_rows([0.5] * 12)
    rows += [(900 + i, rows[3][1], 1) for i in range(200)] + [(None, rows[5][1], 1)]
    want = brute_whitening(rows)
    got = whitening.whiten(table(spark, rows)).collect()
    by_id = {i: w for (i, _), w in want.items()}
    assert len(got) == 4 * 701
    signs = {}
    for r in got:
        n, deviation, white, explained = by_id[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        sign = signs.setdefault(r.component, np.sign(white[r.component - 1] * r.whitened))
        assert abs(sign * white[r.component - 1] - r.whitened) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("size", [1, 1000, 1 << 30, 1 << 62])
def test_scatter_is_exact(size):
    """Sums of products of integers of any size, signs mixed, rows not a multiple of the word."""
    rng = np.random.default_rng(7)
    x = rng.integers(-size, size + 1, (333, 5))
    x[:, 2] = -7
    sums, products = whitening.scatter_block(x)
    y = [[int(c) for c in row] for row in x]
    assert sums.tolist() == [sum(c) for c in zip(*y)]
    assert products.tolist() == [[sum(a * b for a, b in zip(p, q)) for q in zip(*y)] for p in zip(*y)]
    for v in (0, -1, 5, -5, 1 << 200, -(1 << 200) + 3):
        assert sum(part << (whitening.LIMB * k) for k, part in whitening._limbs(v)) == v


def test_whitening_of_little(spark, monkeypatch):
    """No variance, fewer dimensions than components, other lengths, small blocks, huge numbers, no rows."""
    monkeypatch.setattr(whitening, "BLOCK", 8)
    same = whitening.whiten(table(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, 0.0)}
    line = whitening.whiten(table(spark, [(i, [i / 4.0, 0.0, 0.0], 0) for i in range(5)])).collect()
    assert len(line) == 15 and {r.component for r in line} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    assert {round(r.explained, 9) for r in line if r.component == 1} == {1.0} and line[0].identity_error < 1e-9
    mixed = whitening.whiten(table(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [], 0), (4, [-1.0, 1e30], 0)])).collect()
    assert len(mixed) == 8 and {r.n for r in mixed} == {4}
    assert {r.deviation for r in mixed if r.vec_id == 4} == {(1 << 63) - 1}
    assert whitening.whiten(table(spark, odd_rows([0.5] * 3))).collect() == []


# --- near vectors


def brute_links(rows, threshold=0.95):
    v = {}
    for i, x, _ in rows:
        if i is not None:
            ok = x is not None and all(c is not None and math.isfinite(c) for c in x) and any(x)
            v[i] = min((y for y in (v.get(i), list(map(np.float32, x)) if ok else None) if y is not None), default=None)
    out = {i: [0, i] for i in v}
    ids = [i for i in v if v[i] is not None]
    near = {i: [] for i in ids}
    for size in {len(v[i]) for i in ids}:
        own = [i for i in ids if len(v[i]) == size]
        x = np.array([v[i] for i in own], float)
        u = x / np.abs(x).max(1, keepdims=True)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(u @ u.T >= threshold)):
            if a != b:
                near[own[a]].append(own[b])
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = [len(near[i]), min(seen)]
    return {i: (n, c, i == c) for i, (n, c) in out.items()}


def vector_rows():
    """Scattered vectors, a chain, copies, scaled copies, and a group of many near copies."""
    rng = np.random.default_rng(8)
    d = 32
    scattered = rng.normal(size=(900, d))
    start, side = rng.normal(size=(2, d))
    chain = [math.cos(0.25 * t) * start + math.sin(0.25 * t) * (side - start * (side @ start) / (start @ start)) * np.linalg.norm(start) / np.linalg.norm(side) for t in range(6)]
    crowd = rng.normal(size=d) + 0.12 * rng.normal(size=(400, d))
    close = [a + 0.28 * rng.normal(size=d) for a in scattered[:200]]
    x = [*scattered, *chain, *crowd, *close, *[scattered[4]] * 60, *(scattered[5] * s for s in (1e-30, 2.0, 1e30))]
    rows = [(2000 - i, np.asarray(v, np.float32).tolist(), i % 3) for i, v in enumerate(x)]
    rows += odd_rows([0.5] * d) + [(710, [0.0] * d, 1), (711, [], 1), (712, rows[0][1][:16], 1), (713, rows[0][1][:16], 1), (2000, rows[7][1], 1)]
    return rows + [(None, rows[1][1], 1), (None, None, 1)]


def test_links_equal_brute_force(spark, monkeypatch):
    """Every link is found here, and none other; with small blocks, so that popular pieces are cut."""
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    rows = vector_rows()
    want = brute_links(rows)
    got = near_vectors.near_duplicates(table(spark, rows)).collect()
    unnamed = [r for r in got if r.vec_id is None]
    assert [(r.n_links, r.component_id, r.kept) for r in unnamed] == [(0, None, True)] * 2
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert len(found) == len(got) - 2 and found.keys() == want.keys()
    assert all(found[i][0] <= want[i][0] for i in want)
    links, all_links = (sum(n for n, _, _ in x.values()) for x in (found, want))
    assert links >= 0.99 * all_links
    crowd = [i for i in want if want[i][0] >= 300]
    assert len(crowd) > 300 and all(found[i] == want[i] for i in crowd)


def test_recall_at_the_threshold():
    """Pairs of random directions with a cosine of just 0.95 meet in some table."""
    rng = np.random.default_rng(9)
    a, o = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * o
    model = near_vectors.learn(near_vectors.unit(rng.normal(size=(5000, 64))))
    (pa, ma), (pb, mb) = model.of(a), model.of(b)
    differ = pa ^ pb
    assert (((differ & ~ma) == 0) | ((differ & ~mb) == 0)).any(1).mean() > 0.99


def test_codes_are_balanced_and_turned():
    """Learning brings the signs closer to the vectors than the axes' own signs are."""
    x = near_vectors.unit(np.array(clustered(3000, 24, 10), float))
    model = near_vectors.learn(x)
    loss = lambda turned: ((np.sign(turned) / math.sqrt(turned.shape[1]) - turned / np.linalg.norm(turned, axis=1, keepdims=True)) ** 2).sum(1).mean()
    _, axes = np.linalg.eigh(x.T @ x)
    assert loss(x @ model.turn[:, :24]) < loss(x @ axes)
    assert np.abs(((x @ model.turn) > 0).mean(0) - 0.5).mean() < 0.2


@pytest.mark.parametrize(("width", "cone"), [(64, 0.0), (64, 3.0), (24, 0.0), (8, 0.0), (3, 0.0), (2, 0.0)])
def test_recall_of_all_kinds_of_vectors(width, cone):
    """Also where all vectors point one way, and with few dimensions: near pairs share a table's piece but for doubtful
    bits."""
    rng = np.random.default_rng(11)
    x = near_vectors.unit(rng.normal(size=(2000, width)) + cone * np.eye(width)[0] * math.sqrt(width) / 3)
    y = near_vectors.unit(x + 0.25 * rng.normal(size=x.shape) / math.sqrt(width))
    near = (x * y).sum(1) >= 0.95
    model = near_vectors.learn(x)
    (pa, ma), (pb, mb) = model.of(x), model.of(y)
    differ = pa ^ pb
    met = (((differ & ~ma) == 0) | ((differ & ~mb) == 0)).any(1)
    assert near.sum() > 300 and met[near].mean() > 0.98


def test_few_vectors(spark):
    assert near_vectors.near_duplicates(table(spark, [])).collect() == []
    assert [tuple(r) for r in near_vectors.near_duplicates(table(spark, [(3, [0.0, 0.0], 1)])).collect()] == [(3, 0, 3, True)]
    two = near_vectors.near_duplicates(table(spark, [(3, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (9, [1.0], 1)])).collect()
    assert sorted(tuple(r) for r in two) == [(2, 1, 2, True), (3, 1, 2, False), (9, 0, 9, True)]
