import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lectern.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "plain words, and don't we've 12 345!", " \n\n  x\t\ty  ", "ÄÖ été 漢字 \U0001f600 \U000323b0a՘b", "a" * 300, " " * 200 + "z", "'re'll 're", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def truth():
    c = bpe.codec(PATH, P.PATTERN)
    ranks = {b: i for i, b in enumerate(c.bytes) if b}
    return tiktoken.Encoding("truth", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_match_the_library(truth):
    c = bpe.codec(PATH, P.PATTERN)
    for t in TEXTS:
        assert c.encode(c.pieces(t)) == truth.encode_ordinary(t)
        assert c.decode(truth.encode_ordinary(t)) == t.encode()


def test_newer_letters_as_the_library_sees_them(truth):
    c = bpe.codec(PATH, P.PATTERN)
    for a, b in bpe.NEWER_LETTERS + bpe.NEWER_NUMBERS:
        for t in (f"a{chr(a)}a 1{chr(b)}1", f" {chr(a)}a!{chr(b)} {chr(a)}"):
            assert c.encode(c.pieces(t)) == truth.encode_ordinary(t)


def test_stitching_any_cut(truth):
    c, rng = bpe.codec(PATH, P.PATTERN), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'re", "'", "9", "!", "é", "漢", "longerword", "\t "]) for _ in range(rng.randrange(1, 120)))
        size, overlap = rng.randrange(3, 40), rng.randrange(1, 20)
        parts = [bpe.Part.of(c, s, x) for s, x in bpe.chunks_of(text, size, overlap)]
        assert bpe.stitch(c, parts).tolist() == truth.encode_ordinary(text), (text, size, overlap)


def test_rows(spark, truth):
    long = "some words here, été 123 " * 50 + "x" * 700 + " end"
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "hello  world"), (4, long + "!")] + [(10 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = bpe.encode(docs, PATH, P.PATTERN, bpe.digests, bpe.DIGESTS, chunk=128, overlap=32).collect()
    want = []
    for i, t in rows:
        ids = truth.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ids = bpe.encode(docs, PATH, P.PATTERN)
    back = bpe.decode(ids, PATH, P.PATTERN).collect()
    assert sorted((r["doc_id"], bytes(r["bytes"]).decode()) for r in back if r["doc_id"]) == sorted((i, t or "") for i, t in rows if i)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
