import random

import numpy as np

from lectern.llm import importance


def test_good_texts_are_kept(spark):
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}!!" for i in range(300)]
    rows = [(i, " ".join(rng.choice(good if i % 5 else bad) for _ in range(60)), "x") for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None, "x"), (1001, "", "x"), (None, "g1 g2", "x"), (7, rows[7][1], "x")], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(docs, labels).collect()
    assert len(got) == 404
    share = 160 + 1
    assert sum(r["kept"] for r in got) == round(share / 201 * 404)
    judged = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["kept"] == (r["doc_id"] % 5 > 0) for r in judged) > 0.97 * len(judged)
    assert {r["doc_id"]: r["log_weight"] for r in got}[1000] == 0
    again = {(r["doc_id"], r["key"], r["kept"]) for r in importance.resample(docs.repartition(5), labels).collect()}
    assert again == {(r["doc_id"], r["key"], r["kept"]) for r in got}
    assert importance.resample(docs.limit(0), labels).count() == 0
    assert all(r["kept"] for r in importance.resample(docs, labels.limit(0)).collect())


def test_weights_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c A")], "doc_id long, text string")
    ratios = importance.log_ratios(docs, [1])
    import pyarrow as pa

    from lectern.llm import common

    bucket, row = importance.features(*common.flat(pa.array(["a b a", "c A"])))
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    np.add.at(raw, bucket, 1)
    np.add.at(target, bucket[row == 0], 1)
    want = np.log(target / target.sum() * raw.sum() / raw)
    assert np.allclose(ratios, want)
    got = {r["doc_id"]: r["log_weight"] for r in importance.score(docs, ratios).collect()}
    assert np.isclose(got[1], want[bucket[row == 0]].sum())


def test_largest_by_bins(spark):
    rng = random.Random(2)
    keys = [rng.choice([rng.gauss(0, 1), 0.5, -1e6, 1e9]) for _ in range(3000)]
    scored = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "doc_id long, key double")
    for k in (0, 1, 700, 1500, 2999, 3000):
        got = {r["doc_id"] for r in importance.largest(scored, k, ranked=50).collect() if r["kept"]}
        assert got == set(sorted(range(3000), key=lambda i: (-keys[i], i))[:k])


def test_whole_query_like_plain_loops(spark):
    """Hashes of words by Horner's rule, counts, weights, noise and the largest keys, all in plain Python."""
    import math
    import re

    m = (1 << 64) - 1
    base = 0x9E3779B97F4A7C15

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def word(w):
        return mix((sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(w)) + len(w)) & m)

    def grams(text):
        words = [word(w) for w in re.findall(rb"[^ \t-\r]+", re.sub(rb"[A-Z]", lambda x: x.group().lower(), (text or "").encode()))]
        pairs = [mix((a * 0xD6E8FEB86659FD93 + b) & m) for a, b in zip(words, words[1:])]
        return [mix((g + 17) & m) % importance.BUCKETS for g in words + pairs]

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "Bee", "été", "x!", "gh", "漢"]) for _ in range(rng.randrange(0, 40)))) for i in range(150)] + [(200, None), (None, "a Bee"), (3, "copied id"), (4, "very long " * 3000)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(None, 1), (150, None)]
    raw, target, good = [1] * importance.BUCKETS, [1] * importance.BUCKETS, {i for i, q in labels if q == 1}
    for d, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += d is not None and d in good
    ratio = [math.log(a / sum(target) / (b / sum(raw))) for a, b in zip(target, raw)]
    want = []
    for d, t in rows:
        u = ((mix(mix(((d or 0) + 0x5EED) & m)) >> 11) + 0.5) / (1 << 53)
        weight = sum(ratio[g] for g in grams(t))
        want.append([d, weight, weight - math.log(-math.log(u))])
    judged = [q for _, q in labels if q is not None]
    k = round(sum(judged) / len(judged) * len(rows))
    kept = {i for i, _ in sorted(enumerate(want), key=lambda x: (-x[1][2], math.inf if x[1][0] is None else x[1][0]))[:k]}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted(map(tuple, importance.resample(docs, table).collect()), key=lambda r: (r[2], str(r[0])))
    want = sorted(((*w, i in kept) for i, w in enumerate(want)), key=lambda r: (r[2], str(r[0])))
    assert [(r[0], r[3]) for r in got] == [(r[0], r[3]) for r in want]
    assert np.allclose([r[1:3] for r in got], [r[1:3] for r in want])
