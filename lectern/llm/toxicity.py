"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Words are runs of letters and digits, lower-cased. A word enters as the embedding of its hash and as the
mean embedding of its character n-grams, so that unseen forms of known stems are
recognised. Every window of WINDOW words, each overlapping the next by half, is read in both
directions; attention pools the states to one logit. A text's score is the logistic function of
the highest logit of all its windows.

The network is trained here, in numpy, on at most SAMPLE labelled texts of either kind, those
of lowest hash, in STEPS steps of BATCH texts, however many texts there are. Toxic passages are not marked within a text: in every
step all windows of a toxic text are scored, and its label is taught to them by their share of a softmax
over these scores, of which less than FAINT of the highest counts as nothing. A clean text teaches all of its windows alike.
Only text is an input.

STEPS and the number of parameters were chosen by cross-validation among the rows that may be learned from.

Cases: null texts and texts without words score 0; equal texts score alike; very long texts are scored in
all their windows, and in training too; rows with a null doc_id are
scored but never learned from; without labels of both kinds every score is 0; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flat, mix, slices, span_hashes, text_columns

WINDOW, STEP = 32, 16
SAMPLE, STEPS, BATCH, FAINT = 1500, 200, 48, 1e-3
#: Windows that are gone back through at a time.
PIECE = 2048
WORDS, GRAMS, WIDTH, HIDDEN, ATTENTION = 1 << 17, 1 << 17, 8, 8, 8
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _LETTER[_a : _b + 1] = True


class Words:
    """The words of a batch of texts: which distinct word stands where, and the inputs of each distinct word."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        buf = LOWER[buf]
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = _LETTER[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.counts = np.searchsorted(start, off)
        h = span_hashes(buf, start, end)
        names, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.hash = (names % np.uint64(WORDS)).astype(np.int64)
        # Each distinct word between marks, in one buffer of its own.
        s, e = start[first], end[first]
        size = e - s + 2
        base = np.cumsum(size) - size
        own = np.full(int(size.sum()), 1, np.uint8)
        at = np.repeat(s - base - 1, size) + np.arange(len(own))
        body = np.ones(len(own), bool)
        body[base] = body[base + size - 1] = False
        own[body] = buf[at[body]]
        grams, owner = [], []
        for n in (3, 4, 5):
            many = np.maximum(size - n + 1, 0)
            o = np.repeat(np.arange(len(size)), many)
            p = base[o] + np.arange(len(o)) - np.repeat(np.cumsum(many) - many, many)
            grams.append(span_hashes(own, p, p + n))
            owner.append(o)
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.owner = owner[order]
        self.grams = (mix(np.concatenate(grams)[order]) % np.uint64(GRAMS)).astype(np.int64)
        self.many = np.bincount(owner, minlength=len(size))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word numbers of all windows (one past the last for none), and windows before each row, the total last."""
        n = np.diff(self.counts)
        many = np.where(n > 0, np.maximum(1, -(-(n - STEP) // STEP)), 0)
        row = np.repeat(np.arange(len(n)), many)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * STEP
        at = (self.counts[:-1][row] + start)[:, None] + np.arange(WINDOW)
        beyond = at >= self.counts[1:][row][:, None]
        word = np.append(self.word, 0)[np.minimum(at, len(self.word))]
        return np.where(beyond, len(self.hash), word), np.concatenate(([0], np.cumsum(many)))

    def inputs(self, p: dict) -> np.ndarray:
        """Word and character embeddings of every distinct word."""
        chars = np.zeros((len(self.hash), WIDTH), np.float32)
        full = np.flatnonzero(self.many)
        if len(full):
            chars[full] = np.add.reduceat(p["grams"][self.grams], np.searchsorted(self.owner, full)) / self.many[full, None]
        return np.concatenate((p["words"][self.hash], chars), 1)


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    p = {"words": normal(WORDS, WIDTH, scale=0.02), "grams": normal(GRAMS, WIDTH, scale=0.02)}
    for d in "fb":
        p |= {f"W{d}": normal(2 * WIDTH, 3 * HIDDEN, scale=0.4), f"U{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"A": normal(2 * HIDDEN, ATTENTION, scale=0.4), "a": np.zeros(ATTENTION, np.float32), "v": normal(ATTENTION, scale=0.4), "w": normal(2 * HIDDEN, scale=0.4), "o": np.full(1, -2, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(p: dict, d: str, gates: np.ndarray, index: np.ndarray, alive: np.ndarray, out: np.ndarray, tape: list | None = None) -> None:
    """Run one direction over windows; gates: the input's part of the gates of every distinct word. out: windows x WINDOW x HIDDEN."""
    h = np.zeros((len(index), HIDDEN), np.float32)
    u, k = p[f"U{d}"], HIDDEN
    for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
        a, g = gates[index[:, t]], h @ u
        zr = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
        live = alive[:, t, None]
        new = h + live * z * (n - h)
        if tape is not None:
            tape.append((t, h, z, r, n, g[:, 2 * k :], live))
        out[:, t] = h = new


def _attend(p: dict, states: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hidden = np.tanh(states @ p["A"] + p["a"])
    score = np.where(alive > 0, hidden @ p["v"], -1e9)
    share = np.exp(score - score.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    pooled = (share[:, :, None] * states).sum(1)
    return hidden, share, pooled, pooled @ p["w"] + p["o"][0]


def logits(p: dict, x: np.ndarray, index: np.ndarray, most: int = 4096) -> np.ndarray:
    """The logit of every window. x: inputs of the distinct words."""
    x = np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))
    gates = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
    out = np.zeros(len(index), np.float32)
    for lo in range(0, len(index), most):
        part = index[lo : lo + most]
        alive = (part < len(x) - 1).astype(np.float32)
        states = np.empty((len(part), WINDOW, 2 * HIDDEN), np.float32)
        _read(p, "f", gates["f"], part, alive, states[:, :, :HIDDEN])
        _read(p, "b", gates["b"], part, alive, states[:, :, HIDDEN:])
        out[lo : lo + most] = _attend(p, states, alive)[3]
    return out


def shares(logit: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The weight of every window in the loss of a batch. logit: of windows of toxic texts; others do not matter."""
    top = np.full(len(label), -np.inf, np.float32)
    np.maximum.at(top, doc, logit)
    soft = np.exp(2 * (logit - top[doc]))
    soft[soft < FAINT] = 0
    soft /= np.bincount(doc, soft, len(label))[doc]
    return (np.where(label[doc] > 0, soft, 1 / np.sqrt(np.bincount(doc, minlength=len(label))[doc])) / len(label)).astype(np.float32)


def gradients(p: dict, w: Words, index: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict]:
    """Loss and its gradients for windows of texts: doc is the text of each window, label that of each text, weight that of each window (by default shares() of a text's part)."""
    x = np.concatenate((w.inputs(p), np.zeros((1, 2 * WIDTH), np.float32)))
    alive = (index < len(x) - 1).astype(np.float32)
    states = np.zeros((len(index), WINDOW, 2 * HIDDEN), np.float32)
    half, tapes = {"f": slice(0, HIDDEN), "b": slice(HIDDEN, 2 * HIDDEN)}, {"f": [], "b": []}
    for d in "fb":
        _read(p, d, x @ p[f"W{d}"] + p[f"c{d}"], index, alive, states[:, :, half[d]], tapes[d])
    hidden, share, pooled, logit = _attend(p, states, alive)

    if weight is None:
        weight = shares(logit, doc, label)
    prob, y = _sigmoid(logit), label[doc]
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum())
    dl = (weight * (prob - y)).astype(np.float32)

    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"][0], g["w"] = dl.sum(), pooled.T @ dl
    dp = dl[:, None] * p["w"]
    ds = share[:, :, None] * dp[:, None]
    da = (states * dp[:, None]).sum(2)
    de = share * (da - (share * da).sum(1, keepdims=True))
    g["v"] = np.einsum("bt,bta->a", de, hidden)
    dh = de[:, :, None] * p["v"] * (1 - hidden**2)
    g["A"], g["a"] = np.einsum("bts,bta->sa", states, dh), dh.sum((0, 1))
    ds += dh @ p["A"].T

    dx = np.zeros_like(x)
    for d in "fb":
        back = np.zeros((len(index), HIDDEN), np.float32)
        passed = np.zeros((WINDOW, len(index), 3 * HIDDEN), x.dtype)
        for t, h, z, r, n, gn, live in reversed(tapes[d]):
            back += ds[:, t, half[d]]
            dn = back * live * z * (1 - n**2)
            dz = back * live * (n - h) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            passed[t] = np.concatenate((dz, dr, dn), 1)
            dg = np.concatenate((dz, dr, dn * r), 1)
            g[f"U{d}"] += h.T @ dg
            back = back * (1 - live * z) + dg @ p[f"U{d}"].T
        # Words share their part of the gates, so that what comes back is summed by word first.
        by_word, at = np.empty((len(x), 3 * HIDDEN)), index.T.ravel()
        for k, column in enumerate(np.ascontiguousarray(passed.reshape(-1, 3 * HIDDEN).T)):
            by_word[:, k] = np.bincount(at, column, len(x))
        by_word = by_word.astype(x.dtype)
        g[f"W{d}"] += x.T @ by_word
        g[f"c{d}"] += by_word.sum(0)
        dx += by_word @ p[f"W{d}"].T
    np.add.at(g["words"], w.hash, dx[:-1, :WIDTH])
    np.add.at(g["grams"], w.grams, (dx[:-1, WIDTH:] / np.maximum(w.many, 1)[:, None])[w.owner])
    return loss, g


def train(texts: list[str], label: list[int], seed: int = 7, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Parameters learned from labelled texts with words, by Adam."""
    rng = np.random.default_rng(seed)
    p = _fresh(rng)
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    label, queue = np.array(label, np.float32), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(queue) < BATCH:
            queue = np.concatenate((queue, rng.permutation(len(texts))))
        mine, queue = queue[:BATCH], queue[BATCH:]
        w = Words(*flat(pa.array([texts[i] for i in mine], pa.large_string())))
        index, counts = w.windows()
        doc = np.repeat(np.arange(len(mine)), np.diff(counts))
        toxic = np.flatnonzero(label[mine][doc] > 0)
        logit = np.zeros(len(index), np.float32)
        logit[toxic] = logits(p, w.inputs(p), index[toxic])
        weight = shares(logit, doc, label[mine])
        use = np.flatnonzero(weight)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for lo in range(0, len(use), PIECE):
            i = use[lo : lo + PIECE]
            for k, v in gradients(p, w, index[i], doc[i], label[mine], weight[i])[1].items():
                g[k] += v
        rate = 0.02 * (1 - 0.8 * (step - 1) / steps)
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            s[k] += 0.01 * (g[k] ** 2 - s[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    return p


def is_held_out(doc_id: str) -> F.Column:
    """Rows that nothing is learned from: crc32 of the doc_id's digits leaves 1 modulo 3, or the doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """The parameters, or None if labels of either kind are missing."""
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").where(~is_held_out("doc_id"))
    judged = judged.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [judged.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = {r["doc_id"]: r["toxic"] for c in chosen for r in c.collect()}
    if len(set(chosen.values())) < 2:
        return None
    ids = np.array(sorted(chosen), np.int64)

    def chosen_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            b = b.filter(pa.array(np.isin(b["doc_id"].to_numpy(), ids)))
            w = Words(*flat(b["text"]))
            yield b.filter(pa.array(np.diff(w.counts) > 0))

    rows = text_columns(docs).where("doc_id IS NOT NULL").mapInArrow(chosen_texts, "doc_id long, text string")
    # A doc_id that stands in many rows teaches by the first of their texts: twice `sample` rows at most reach the driver.
    found = {r["doc_id"]: r["text"] for r in rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    use = sorted(found)
    if len({chosen[i] for i in use}) < 2:
        return None
    return train([found[i] for i in use], [chosen[i] for i in use])


def score(docs: DataFrame, p: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, score of every row of docs."""
    parameters = docs.sparkSession.sparkContext.broadcast(p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parameters.value
        for b in slices(batches, "text", 1 << 20):
            scores = np.zeros(b.num_rows)
            if p is not None:
                w = Words(*flat(b["text"]))
                index, counts = w.windows()
                full = np.flatnonzero(np.diff(counts))
                if len(full):
                    scores[full] = _sigmoid(np.maximum.reduceat(logits(p, w.inputs(p), index), counts[full]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores)], names=["doc_id", "score"])

    return text_columns(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = score(docs, fit(docs, labels)).withColumn("held_out", is_held_out("doc_id"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
