import random

import numpy as np
import pytest

from lectern.llm import lattice


def brute(rows, cosine=0.98):
    def vector(r):
        d, v, label = r
        if d is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.abs(v).max()

    vs, n = [vector(r) for r in rows], len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vs[i], vs[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i)), r[0] is None or r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str)


def corpus(seed, dims):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    rows = [(None, [1.0] * dims, 1), (1, None, 1), (2, [], 1), (3, [0.0] * dims, 1), (4, [1.0, None] * (dims // 2), 1), (5, [float("nan")] * dims, 1), (6, [float("inf")] * dims, 1), (7, [1.0] * dims, None), (8, [1.0] * (dims + 1), 1)]
    i = 10
    for _ in range(40):
        base = rng.normal(size=dims)
        for _ in range(pick.randrange(1, 14)):
            v = base + rng.normal(size=dims) * pick.choice([0, 0.02, 0.1, 0.2])
            rows.append((i, (v * pick.choice([1.0, 1.0, 5.0])).tolist(), pick.choice([1, 1, 2])))
            i += 1
    rows += rows[-4:]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("dims, tile", [(64, 1024), (64, 5), (10, 1024)])
def test_against_all_pairs(spark, monkeypatch, dims, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    rows = corpus(dims, dims)
    table = spark.createDataFrame([(a, b, c, 7) for a, b, c in rows], "vec_id long, embedding array<double>, label int, n_links int")
    assert sorted(map(tuple, lattice.near_duplicates(table).collect()), key=str) == brute(rows)
    assert lattice.near_duplicates(table.limit(0)).count() == 0


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 2
    found = lattice.decode(x)
    assert len(lattice.minimal_vectors()) == 240
    for step in lattice.minimal_vectors():
        assert (((x - found) ** 2).sum(1) <= ((x - found - step) ** 2).sum(1) + 1e-9).all()
    doubled = np.rint(2 * found).astype(int)
    assert (doubled == 2 * found).all() and (np.ptp(doubled % 2, axis=1) == 0).all() and (doubled.sum(1) % 4 == 0).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (lattice.cells(v, np.zeros(len(v), np.int64)) for v in (x, y))
    met = (a[..., :, None] == b[..., None, :]).any((2, 3))
    assert met.mean() > 0.75 and met.any(1).mean() > 0.9995


def test_labels_are_compared_in_their_own_type(spark):
    rows = [(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.9), (3, [1.0, 0.01], 1.2), (4, [1.0, 0.0], None), (5, [1.0, 0.0], float("nan"))]
    for kind, show in (("double", lambda x: x), ("string", lambda x: None if x is None else str(x))):
        df = spark.createDataFrame([(i, v, show(x)) for i, v, x in rows], f"vec_id long, embedding array<double>, label {kind}")
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df).collect()}
        assert got == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False), 4: (0, 4, True), 5: (0, 5, True)}
