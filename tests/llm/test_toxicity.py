import random
import zlib

import numpy as np
import pyarrow as pa

from lectern.llm import common, toxicity


def test_words_and_windows():
    w = toxicity.Words(*common.flat(pa.array(["One, two!THREE", None, "", "été", " ".join(f"w{i}" for i in range(40))])))
    assert w.counts.tolist() == [0, 3, 3, 3, 4, 44]
    index, counts = w.windows()
    assert counts.tolist() == [0, 1, 1, 1, 2, 4]
    none = len(w.hash)
    assert (index[0] != none).sum() == 3 and (index[2] != none).sum() == 32 and (index[3] != none).sum() == 24
    assert index[3, 0] == index[2, 16]
    assert toxicity.Words(*common.flat(pa.array(["", None]))).windows()[0].shape == (0, 32)


def test_gradients_by_differences():
    rng = np.random.default_rng(5)
    p = {k: v.astype(np.float64) for k, v in toxicity._fresh(rng).items()}
    texts = ["you are a fine person", "bad idiot words here today", "nothing much", "more of the same fine words"]
    w = toxicity.Words(*common.flat(pa.array(texts)))
    index, _ = w.windows()
    doc, label = np.array([0, 1, 1, 2]), np.array([0.0, 1.0, 0.0])
    _, g = toxicity.gradients(p, w, index, doc, label)
    # The weights of a toxic text's windows count as constants, so compare on clean texts and on one window each.
    doc, label = np.arange(4), np.array([0.0, 1.0, 0.0, 1.0])
    _, g = toxicity.gradients(p, w, index, doc, label)
    for k in p:
        flat = np.flatnonzero(g[k].ravel())[:6]
        for i in flat:
            e = 1e-2
            old = p[k].flat[i]
            p[k].flat[i] = old + e
            up = toxicity.gradients(p, w, index, doc, label)[0]
            p[k].flat[i] = old - e
            down = toxicity.gradients(p, w, index, doc, label)[0]
            p[k].flat[i] = old
            assert abs((up - down) / (2 * e) - g[k].flat[i]) < 2e-3 + 0.05 * abs(g[k].flat[i]), k


def test_learns_and_holds_out(spark):
    rng = random.Random(3)
    clean = ["the", "of", "and", "river", "stone", "light", "walked", "along", "quiet", "table"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) + rng.choice(["", "", "s", "er"]) for _ in range(rng.randrange(5, 120))]
        toxic = i % 4 == 0
        for _ in range(1 + len(words) // 30 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "vermin", "grolak" + rng.choice("abcdefgh")]) + rng.choice(["", ","])
        rows.append((i, " ".join(words), 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None, 1), (1001, "", 1), (None, rows[1][1], 1), (1, rows[1][1], 1)], "doc_id long, text string, score int")
    table = spark.createDataFrame(labels + [(None, 1, 1), (2000, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, table).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1000] == scores[1001] == 0
    assert toxicity.classify(docs.limit(0), table).count() == 0
    assert all(r["score"] == 0 for r in toxicity.classify(docs.limit(5), table.limit(0)).collect())


def plain_score(p, text):
    """The network in plain loops, from the words of one text to the highest of its windows."""
    import math
    import re

    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    of = lambda data: common.span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0]
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode() if text.isascii() else text.encode())
    if not words:
        return 0.0
    vectors = []
    for word in words:
        marked = b"\x01" + word + b"\x01"
        grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        rows = [p["grams"][int(common.mix(np.array([of(x)]))[0] % np.uint64(toxicity.GRAMS))] for x in grams]
        chars = [sum(float(r[k]) for r in rows) / len(rows) if rows else 0.0 for k in range(toxicity.WIDTH)]
        vectors.append([float(v) for v in p["words"][int(of(word) % np.uint64(toxicity.WORDS))]] + chars)
    mul = lambda v, m: [sum(a * float(m[i][k]) for i, a in enumerate(v)) for k in range(len(m[0]))]
    n = toxicity.HIDDEN

    def read(xs, d):
        h, out = [0.0] * n, []
        for x in xs:
            a = [u + float(c) for u, c in zip(mul(x, p[f"W{d}"]), p[f"c{d}"])]
            g = mul(h, p[f"U{d}"])
            z, r = [sigmoid(a[k] + g[k]) for k in range(n)], [sigmoid(a[n + k] + g[n + k]) for k in range(n)]
            new = [math.tanh(a[2 * n + k] + r[k] * g[2 * n + k]) for k in range(n)]
            h = [h[k] + z[k] * (new[k] - h[k]) for k in range(n)]
            out.append(h)
        return out

    best = -math.inf
    for begin in range(0, max(1, len(words) - toxicity.STEP), toxicity.STEP):
        xs = vectors[begin : begin + toxicity.WINDOW]
        states = [f + b for f, b in zip(read(xs, "f"), read(xs[::-1], "b")[::-1])]
        hidden = [[math.tanh(u + float(c)) for u, c in zip(mul(s, p["A"]), p["a"])] for s in states]
        weights = [math.exp(sum(u * float(v) for u, v in zip(x, p["v"]))) for x in hidden]
        pooled = [sum(w * s[k] for w, s in zip(weights, states)) / sum(weights) for k in range(2 * n)]
        best = max(best, sum(u * float(v) for u, v in zip(pooled, p["w"])) + float(p["o"][0]))
    return sigmoid(best)


def test_scores_like_plain_loops(spark):
    rng = np.random.default_rng(2)
    p = {k: v * (20 if k in ("words", "grams") else 1) for k, v in toxicity._fresh(rng).items()}
    say = random.Random(1)
    texts = ["One, two! THREE", "x", "", None, "été naïve", " ".join(say.choice(["a", "Fine", "day", "grolak", "x9"]) for _ in range(130)), " ".join(f"w{i}" for i in range(48)), " ".join(f"v{i}" for i in range(49)), "é" * 3 + " " + "ab " * 20]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p).collect()}
    assert all(abs(got[i] - plain_score(p, t or "")) < 1e-4 for i, t in enumerate(texts)), got


def test_training_uses_all_windows():
    """The only toxic words stand far behind in long texts."""
    rng = random.Random(4)
    clean = [f"w{i}" for i in range(50)]
    texts = [" ".join([rng.choice(clean) for _ in range(3000)] + (["vermin"] * 3 if i % 2 else []) + [rng.choice(clean) for _ in range(40)]) for i in range(24)]
    p = toxicity.train(texts, [i % 2 for i in range(24)], steps=40)
    w = toxicity.Words(*common.flat(pa.array(["w1 w2 vermin w3", "w1 w2 w4 w3"])))
    high, low = toxicity.logits(p, w.inputs(p), w.windows()[0])
    assert high > low + 1


def test_a_repeated_doc_id_teaches_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: (texts, labels))
    ids = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    rows = [(ids[0], f"text {k:03d}") for k in range(200)] + [(i, f"own words {i}") for i in ids[1:]] + [(ids[1], None), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) == (["text 000"] + [f"own words {i}" for i in ids[1:]], [1, 0, 0, 0])
