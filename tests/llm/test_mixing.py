import random
from collections import Counter, defaultdict

import duckdb
import pytest

from lectern.llm import mixing

FIELDS = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Targets by source (name or None), sizes: source to words, by filling up in small steps of sources that stop."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    open_, out, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not full:
            return out | {s: min(3.0 * sizes[s], level * weight[s]) for s in open_}
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_like_a_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 1000, 100_000]) for i in range(rng.randrange(1, 12))}
    if seed % 2:
        sizes[None] = rng.choice([0, 3, 5000])
    rows = [(s, n // 3) for s, n in sizes.items()] + [(s, n - n // 3) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def table(spark, docs):
    return spark.createDataFrame([(i, None if n is None else " ".join(["w"] * n), s) for i, n, s in docs], FIELDS)


def check(spark, docs):
    df = table(spark, docs)
    got = [r.asDict() for r in mixing.mix(df).collect()]
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, n or 0, s) for i, n, s in docs)
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in got)
    con = duckdb.connect()
    documents = df.toArrow()  # noqa: F841 - read by the SQL
    want = con.sql(mixing.ORACLE)
    cols = want.columns
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == sorted(want.fetchall(), key=str)
    return got


def by_source(got):
    out = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        t = out[r["source"]]
        t[0], t[1], t[2] = t[0] + r["taken"], r["target"], max(t[2], r["size"])
    return out


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([None, 0, 1, 7, 30, 30, 200, rng.randrange(1, 800)]), rng.choice(["a", "a", "a", "a", "a", "b", "c", "d", None, ""])) for i in range(3000)]
    for taken, target, longest in by_source(check(spark, docs)).values():
        assert abs(taken - target) <= longest / 2 + 1


def test_edges(spark):
    assert check(spark, []) == []
    assert [r["taken"] for r in check(spark, [(1, 5, "a")])] == [5]
    assert all(r["taken"] == 0 for r in check(spark, [(1, 0, "a"), (2, None, None)]))
    giant = by_source(check(spark, [(0, 50_000, "a")] + [(i, 10, "a") for i in range(1, 100)] + [(1000 + i, 100, "b") for i in range(400)]))
    assert giant["b"][0] >= 100
    check(spark, [(7, 10, "a")] * 50 + [(None, 10, "a")] * 50 + [(8, 10, None)] * 9 + [(9, 0, None)])
    assert len(check(spark, [(i, 3, f"h{i:04d}") for i in range(300)])) == 300


def test_inclusion_follows_size(spark):
    """Over many tables (shifted doc_ids draw other numbers) documents are drawn as often as their probability says."""
    sizes = [10] * 40 + [20] * 20 + [40] * 10 + [400]
    runs, hits = 60, Counter()
    docs = [(10_000 * k + i, n, f"s{k:03d}") for k in range(runs) for i, n in enumerate(sizes)]
    got = mixing.mix(table(spark, docs)).collect()
    expected = defaultdict(float)
    for r in got:
        whole = int(r["target"] // r["source_size"])
        missing = r["target"] - whole * r["source_size"]
        if missing >= 400:  # the longest is certain
            rate = (missing - 400) / (40 * 100 + 20 * 400 + 10 * 1600)
            expected[r["size"]] += 1.0 if r["size"] == 400 else min(1.0, rate * r["size"])
        elif missing >= 200:
            continue
        else:
            rate = missing / (40 * 100 + 20 * 400 + 10 * 1600)
            expected[r["size"]] += 0.0 if r["size"] == 400 else min(1.0, rate * r["size"])
        hits[r["size"]] += r["copies"] - whole
    assert all(hits[n] == pytest.approx(expected[n], rel=0.12, abs=12) for n in (10, 20, 40)), (hits, expected)
    assert hits[400] == pytest.approx(expected[400], abs=1)


def test_repeat_keeps_rows_whole(spark):
    rows = [(i, "w " * (i % 9 + 1), ["x", "y", None][i % 3], {"k": i}, i * 2, "r", None) for i in range(60)] + [(3, "w w", "x", {}, 0, "s", None)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` map<string,int>, `my col` int, row string, copies void")
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len(r["text"].split())) for r in out.collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    assert all(r["a.b"] in ({"k": r["doc_id"]}, {}) for r in out.collect())
    assert mixing.repeat(docs.limit(0)).count() == 0
