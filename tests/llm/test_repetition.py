import random

import numpy as np
import pyarrow as pa

from lectern.llm import common, repetition


def brute(words):
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_longest_repeats_against_all_pairs():
    rng = random.Random(3)
    for _ in range(60):
        rows = [[rng.randrange(3) for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(1, 6))]
        counts = np.cumsum([0, *map(len, rows)])
        got = repetition.longest_repeats(np.array(sum(rows, []), np.int64), counts)
        assert got.tolist() == sum(map(brute, rows), [])


def test_measures():
    texts = ["a b c\na b c\n\n \na b c d", None, "", "x", "Ä|b #\n$$", " ".join(map(str, range(60)))]
    m = repetition.measure(*common.flat(pa.array(texts)))
    assert m["n_words"].tolist() == [10, 0, 0, 1, 3, 60]
    assert m["n_dup_lines"].tolist() == [1, 0, 0, 0, 0, 0]
    assert m["n_repeat_words"].tolist() == [9, 0, 0, 0, 0, 0]
    assert m["word_chars"].tolist()[:5] == [10, 0, 0, 1, 6]
    assert m["n_symbols"].tolist()[:5] == [0, 0, 0, 0, 4]


def test_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    loop = " ".join(f"w{i % 20}" for i in range(200))
    partly = clean + " " + " ".join(f"w{i}" for i in range(120))
    rows = [(1, clean, "a"), (1, clean, "a"), (2, loop, None), (3, partly, "c"), (4, None, "d"), (None, clean, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {(r["doc_id"], r["base_failed"], r["kept"], r["keep_n_words"]) for r in repetition.judge(docs, "n_words").collect()}
    assert got == {(1, False, True, "a"), (2, True, False, None), (3, True, False, "c"), (4, True, False, "d"), (None, False, True, "e")}
    assert repetition.judge(docs.limit(0)).count() == 0


def test_hashes_do_not_hang_on_pieces():
    text = " ".join(random.Random(1).choice(["a", "bb", "long" * 40]) for _ in range(3000))
    buf, off = common.flat(pa.array([text]))
    start, end, _ = common.words_of(buf, off)
    assert (common.span_hashes(buf, start, end, 256) == common.span_hashes(buf, start, end)).all()


def test_columns_of_any_name_and_type(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, {"a": 1}, None)], "doc_id long, text string, `my col` int, `a.b` map<string,int>, kept string")
    out = repetition.judge(docs, "my col", "a.b", "kept")
    row = out.select("doc_id", "`keep_my col`", "`keep_a.b`", "keep_kept").first()
    assert tuple(row) == (1, 1, {"a": 1}, None)


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    row = repetition.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_repeat_words"], row["covered_words"], row["longest_repeat"], row["kept"]) == (300_000, 300_000, 300_000, 295_000, False)
