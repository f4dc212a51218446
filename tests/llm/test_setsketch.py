import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import common, components, setsketch


def sets(text, n):
    w = [x for x in (text or "").lower().split() if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, percent):
    s = [sets(t, n) if i is not None else set() for i, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets(t, n)), least.get(find(i)), d is None or d == least[find(i)]) for i, (d, t) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "lost words here"), (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1005, "other text of the same id")]
    i = 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 120, 300]))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 30, len(base) // 18])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_components_against_all_pairs(spark, words, monkeypatch):
    rows = corpus(words)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = sorted(map(tuple, setsketch.near_duplicates(docs, words).collect()), key=str)
    assert got == brute(rows, words, 80)
    assert setsketch.near_duplicates(docs.limit(0), words).count() == 0


def test_tiles_compare_every_pair(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "TILE", 4)
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, setsketch.near_duplicates(docs, 2).collect()), key=str)
    assert got == brute(rows, 2, 80)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in range(3000)]
    a, b = words[:2000], words[200:2200]
    buf, off = common.flat(pa.array([" ".join(a), " ".join(b), " ".join(a + b[1800:])]))
    regs = setsketch.registers(setsketch.shingle_sets(buf, off, 2), 3)
    assert (np.maximum(regs[0], regs[1]) >= regs[2]).mean() > 0.95
    sizes = np.array([1999])
    assert setsketch.likely(regs[:1], regs[1:2], sizes, sizes)[0]
    far = setsketch.registers(setsketch.shingle_sets(*common.flat(pa.array([" ".join(rng.permutation(words)[:2000])])), 2), 1)
    assert not setsketch.likely(regs[:1], far, sizes, sizes)[0]


def test_connected(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components.connected(spark.createDataFrame(edges, "u long, v long"), len(edges)).collect()}
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: find(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "u long, v long"), 0).count() == 0


def test_hot_keys_are_joined_where_they_are(spark):
    """Hubs, copies and components above join_hot's bound, which the table's size sets to 1,000 rows."""
    from lectern.llm import common
    from lectern.llm.components import connected

    n = 25_000
    edges = spark.range(1, n).selectExpr("id AS u", "0L AS v").unionByName(spark.createDataFrame([(n + 1, n + 2), (n + 2, n + 3)], "u long, v long"))
    got = connected(edges, n)
    assert {r["component"]: r["count"] for r in got.groupBy("component").count().collect()} == {0: n, n + 1: 3}
    left = spark.range(n).selectExpr("if(id < 20000, 1, id) AS k", "id AS x")
    right = left.groupBy("k").count().withColumnRenamed("count", common.MEMBERS).selectExpr("k", common.MEMBERS, "k * 2 AS y").where("k % 5 != 0")
    for how, rows in (("inner", 20_000 + 4_000), ("left", n)):
        out = common.join_hot(left, right, ["k"], n, how)
        assert out.count() == rows and out.where("y IS NOT NULL AND y != 2 * k").count() == 0 and out.where("y IS NOT NULL").count() == 24_000


def test_torn_buckets_of_many_tiles(spark):
    """Many members of one component, a few others in the same buckets: every link between them is found."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base + [f"x{i}"]) for i in range(700)] + [" ".join(base[:57] + [f"y{i}" for i in range(k)]) for k in (1, 2, 3, 9, 20)] + [" ".join(rng.sample(base, 60)) for _ in range(3)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = sorted(map(tuple, setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()))
    assert got == sorted(brute(rows, 2, 80))


def test_very_long_texts(spark):
    words = [f"w{i % 7001}-{i // 7001}" for i in range(120_000)]
    near = words[:60_000] + ["other"] + words[60_001:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(words[:90_000]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (119_996, 3), 3: (119_996, 3), 4: (89_996, 4)}
