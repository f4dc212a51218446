import hashlib
import random

import numpy as np
import pytest

from lectern.llm import suffixes


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49) if d is not None else ():
            s = b[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "the", "résumé", "of", "lattice", "x1", "naïve", "quite"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(rng.randrange(12, 40)) for _ in range(6)] + ["ab" * 60, "z" * 130]
    rows = [(None, shared[0]), (900, None), (901, ""), (902, "short"), (3, say(100)), (3, shared[1])]
    for i in range(40):
        rows.append((i, "\n".join([say(rng.randrange(0, 30)), rng.choice(shared)[rng.randrange(0, 20) :], say(rng.randrange(0, 8)), rng.choice(shared)])))
    rows += [(200 + i, rows[10 + i % 3][1]) for i in range(6)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot, block", [(20_000, 8 << 20), (1, 2_000), (3, 500)])
def test_against_all_strings(spark, hot, block):
    rows = corpus(hot)
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, n_bytes long").repartition(3)
    got = sorted(map(tuple, suffixes.remove_repeats(docs, hot=hot, block=block).collect()), key=str)
    assert got == brute(rows)
    carried = suffixes.remove_repeats(docs, "n_bytes", texts=True).collect()
    assert all(r["keep_n_bytes"] == r["doc_id"] for r in carried)
    assert len(carried) == len(rows)
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot, block", [(20_000, 8 << 20), (1, 500)])
def test_repeated_rows_in_several_blocks(spark, hot, block):
    rows = corpus(5)
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    dealt = spark.createDataFrame(rows + rows[::-1], "doc_id long, text string").repartition(5)
    for docs in (one.union(one), dealt):
        assert sorted(map(tuple, suffixes.remove_repeats(docs, hot=hot, block=block).collect()), key=str) == brute(rows + rows)


def test_blind_trie_sorts():
    rng = random.Random(4)
    for _ in range(200):
        strings = list({bytes(rng.choice(b"ab\x00\xff") for _ in range(6)) for _ in range(rng.randrange(1, 30))})
        assert [strings[i] for i in suffixes.blind_trie_order(strings)] == sorted(strings)


def test_order_of_strings():
    rng = random.Random(6)
    text = bytes(rng.choice(b"ab") for _ in range(300)) + b"c" * 80 + bytes(rng.choice(b"ab") for _ in range(40)) + b"ab" * 60 + b"ab" * 40
    buf = np.frombuffer(text + bytes(8), np.uint8)
    start = np.arange(len(text) - 49)
    place = suffixes.same_strings(buf, start)
    strings = [text[i : i + 50] for i in start]
    rank = {s: sorted(strings).index(s) for s in set(strings)}
    assert place.tolist() == [rank[s] for s in strings]


def test_whole_characters():
    buf = np.frombuffer("aéb漢".encode(), np.uint8)
    gone = np.array([True, True, False, True, True, True, True])
    assert suffixes.whole_characters(buf, gone).tolist() == [True, False, False, True, True, True, True]


def anchors(runs):
    """Anchor of every string by its start."""
    return {s: (a, p) for f, l, a, p in zip(runs.first.tolist(), runs.last.tolist(), runs.anchor.tolist(), runs.place.tolist()) for s in range(f, l + 1)}


def test_runs_do_not_hang_on_pieces():
    import pyarrow as pa

    from lectern.llm import common

    rng = random.Random(8)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (30, 49, 50, 51, 400, 3, 0, 900)]
    buf, off = common.flat(pa.array(texts))
    whole, cut = suffixes.runs_of(buf, off), suffixes.runs_of(buf, off, piece=70)
    starts = [int(o) + i for o, t in zip(off, texts) for i in range(len(t) - 49)]
    assert sorted(anchors(whole)) == starts and anchors(cut) == anchors(whole)
    assert sum(cut.last - cut.first + 1) == len(starts)


@pytest.mark.parametrize("hot, bits", [(20_000, 0), (20_000, 3), (50, 2)])
def test_colliding_hashes_remove_nothing_more(spark, hot, bits):
    """Anchors that meet by chance alone are compared byte by byte."""
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffixes.remove_repeats(docs, hot=hot, block=1500, bits=bits).collect()), key=str) == brute(rows)


def test_entries_are_equal_by_their_bytes():
    import pyarrow as pa

    from lectern.llm import common

    rows = sorted((d, t or "") for d, t in corpus(2) if d is not None)
    buf, off = common.flat(pa.array([t for _, t in rows]))
    row = {"ids": np.array([d for d, _ in rows], np.int64).tobytes(), "off": off.tobytes(), "data": pa.compress(buf.tobytes(), codec="zstd", asbytes=True)}
    whole, poor = suffixes.Block(row), suffixes.Block(row, context_bits=0)
    text = lambda k, i: (k.buf[k.runs.first[i] : k.runs.last[i] + suffixes.SPAN].tobytes(), int(k.runs.place[i] - k.runs.first[i]))
    for k in (whole, poor):
        assert all(text(k, i) == text(k, k.where[e]) for i, e in enumerate(k.entry))
    assert len(whole.where) == len({text(whole, i) for i in range(len(whole.entry))}) < len(whole.entry)
    assert len(poor.where) > len(whole.where)


def test_multikey_quicksort_and_groups():
    rng = random.Random(11)
    lengths = {0: 50, 1: 61, 2: 81}
    strings = [(g, bytes(rng.choice(b"ab") for _ in range(20)) + rng.choice([b"x" * 20, b"y" * 20]) + bytes(rng.choice(b"ab") for _ in range(3)) + b"z" * (lengths[g] - 43)) for g in (rng.randrange(3) for _ in range(500))]
    strings += strings[:100]
    buf = np.frombuffer(b"".join(s for _, s in strings) + bytes(8), np.uint8)
    length = np.array([len(s) for _, s in strings])
    place = suffixes.same_strings(buf, np.cumsum(length) - length, length, np.array([g for g, _ in strings]))
    order = sorted(strings)
    assert place.tolist() == [order.index(x) for x in strings]


def test_columns_of_any_name_and_type(spark):
    text = "some words that are repeated in a later document, more than fifty bytes of them"
    docs = spark.createDataFrame([(1, text, 1, {"a": 1}, [1], "x"), (2, text, 2, None, None, None), (None, text, 3, {}, [], "")], "doc_id long, text string, `my col` int, `a.b` map<string,int>, `a-b` array<int>, n_bytes string")
    out = suffixes.remove_repeats(docs, "my col", "a.b", "a-b", "n_bytes", texts=True)
    got = sorted(map(tuple, out.collect()), key=lambda r: r[5])
    assert got == [(1, len(text), 0, 0, text, 1, {"a": 1}, [1], "x"), (2, len(text), len(text), 1, "", 2, None, None, None), (None, len(text), 0, 0, text, 3, {}, [], "")]
    assert out.columns[5:] == ["keep_my col", "keep_a.b", "keep_a-b", "keep_n_bytes"]
