import random

import numpy as np
import public_tokenizers as P

from lectern.llm import packing

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def slow(sizes, length):
    rows = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [length - sum(sizes[j] for j in r) for r in rows]
        best = min((f for f in fits if f >= sizes[i]), default=None)
        if best is None:
            rows.append([i])
        else:
            rows[max(k for k, f in enumerate(fits) if f == best)].append(i)
    return rows


def test_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(80):
        length = rng.randrange(1, 40)
        sizes = [rng.randrange(1, length + 1) for _ in range(rng.randrange(0, 60))]
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(sum(got, [])) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in r) <= length for r in got)
        room = lambda rows: sorted(length - sum(sizes[i] for i in r) for r in rows)
        assert room(got) == room(slow(sizes, length))


def test_round_trip(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["word", "été", "漢字", "12"]) for _ in range(rng.choice([1, 20, 90, 300]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, "no id"), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    packed = packing.pack(docs, PATH, P.PATTERN, length=64, group=2000).collect()
    enc, found = packing.tokenizer(PATH, P.PATTERN), {}
    for r in packed:
        ids, pos = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert (ids[r["n_tokens"] :] == enc.n_vocab).all()
        for d, k, a, b in zip(r["doc_ids"], r["parts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            found.setdefault((r["pack"], d), []).append((k, ids[a:b].tolist()))
    texts_back = []
    for (_, d), parts in found.items():
        copies = sum(k == 0 for k, _ in parts)
        parts.sort(key=lambda p: p[0])
        joined = b"".join(enc.decode_bytes(x) for _, x in parts[::copies])
        texts_back += [(d, joined.decode())] * copies
    assert sorted(texts_back, key=str) == sorted(((i, t) for i, t in rows if t), key=str)
    assert packing.pack(docs.limit(0), PATH, P.PATTERN).count() == 0
    assert packing.digests(packing.pack(docs, PATH, P.PATTERN)).count() > 0


def plain(rows, length, group):
    """Every pack as plain lists: {(doc_id, part, ids) of each row's segments, in order}, by pack and row."""
    enc = packing.tokenizer(PATH, P.PATTERN)
    total = sum(len((t or "").encode()) for _, t in rows)
    groups = max(1, -(-total // (group * packing.BYTES_A_TOKEN)))
    from lectern.llm import common

    packs = {}
    for d, t in rows:
        if t:
            data = np.frombuffer(t.encode(), np.uint8)
            h = common.mix(common.span_hashes(data, np.array([0]), np.array([len(data)])) ^ common.mix(np.array([-1 if d is None else d]).view(np.uint64)))[0]
            packs.setdefault(int(h % np.uint64(groups)), []).append((d, enc.encode_ordinary(t)))
    out = {}
    for g, docs in packs.items():
        docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
        pieces = [(d, k // length, tuple(ids[k : k + length])) for d, ids in docs for k in range(0, len(ids), length)]
        for r, members in enumerate(slow([len(p[2]) for p in pieces], length)):
            out[g, r] = sorted((pieces[i] for i in members), key=str)
    return out


def segments(table, length):
    ids, pos = packing.matrices(table, length)
    out = {}
    for i, r in enumerate(table.to_pylist()):
        bounds = list(zip(r["cu_seqlens"], r["cu_seqlens"][1:]))
        assert r["cu_seqlens"][0] == 0 and bounds[-1][1] == r["n_tokens"] <= length
        assert all(pos[i, a:b].tolist() == list(range(b - a)) for a, b in bounds)
        out[r["pack"], r["row"]] = [(d, k, tuple(ids[i, a:b].tolist())) for d, k, (a, b) in zip(r["doc_ids"], r["parts"], bounds)]
    return out


def test_whole_packing_like_plain_lists_in_any_partitioning(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["word", "naïve", "漢字", "12"]) for _ in range(rng.choice([1, 5, 20, 90, 300]))) for _ in range(120)] + ["long text " * 2000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, "no id"), (None, "no id"), (5, texts[5]), (5, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, seen = plain(rows, 64, 1000), []
    for n in (1, 4, 16):
        path = str(tmp_path / f"packs{n}")
        packing.write(packing.pack(docs.repartition(n), PATH, P.PATTERN, length=64, group=1000), path)
        got = segments(pq.read_table(path), 64)
        # Bins of equal room may be filled in another order than in the plain list: the rows' fills and all segments are the same.
        for g in {g for g, _ in want}:
            fills = lambda packs: sorted(sum(len(p[2]) for p in s) for (x, _), s in packs.items() if x == g)  # noqa: E731, B023
            parts = lambda packs: sorted((p for (x, _), s in packs.items() if x == g for p in s), key=str)  # noqa: E731, B023
            assert fills(got) == fills(want) and parts(got) == parts(want)
        assert {g for g, _ in got} == {g for g, _ in want} and len(got) == len(want)
        seen.append(sorted((tuple(r.values()) for r in packing.digests(spark.read.parquet(path)).toArrow().to_pylist()), key=str))
    assert seen[0] == seen[1] == seen[2]
    assert sum(r[2] for r in seen[0]) / (64 * len(seen[0])) > 0.95
