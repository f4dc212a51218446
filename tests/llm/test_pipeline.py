import hashlib
import random

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest

from pyspark.sql import functions as F

from lectern.llm import bpe, mixing, repetition
from tests.llm import test_setsketch, test_suffixes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)] + ["été", "漢字"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows = " ".join(say(40)), []
    for i in range(60):
        text = say(rng.choice([20, 80, 150]))
        if i % 7 == 0:
            text = text[:10] * 12
        rows.append((i, " ".join(text) + (f"\n{passage}\n" + " ".join(say(60)) if i % 5 == 0 else ""), "en", f"src{i % 4}"))
    for i in range(60, 80):
        near = rows[i - 60][1].split(" ")
        near[rng.randrange(len(near))] = "changed"
        rows.append((i, " ".join(near), "en", None if i % 3 else "src1"))
    rows += [(90, None, "en", "src0"), (91, "", None, None), rows[33]]
    return [(*r, len(r[1] or "")) for r in rows]


def brute(rows):
    t = pd.DataFrame(rows, columns=COLUMNS)
    sql = lambda query, documents: duckdb.connect().register("documents", documents).sql(query).df()
    kept = sql(repetition.ORACLE, t)
    t = t[t.doc_id.isin(kept[kept.kept].doc_id)]
    near = {r[0] for r in test_setsketch.brute(list(zip(t.doc_id, t.text)), 5, 80) if r[3]}
    t = t[t.doc_id.isin(near)].drop_duplicates()
    first = {}
    for d, x in zip(t.doc_id, t.text):
        b = x.encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    texts = []
    for d, x in zip(t.doc_id, t.text):
        b = x.encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        out, at = [], 0
        for ch in x:
            n = len(ch.encode())
            if not all(gone[at : at + n]):
                out.append(ch)
            at += n
        texts.append("".join(out))
    t = t.assign(text=texts)
    mix = sql(mixing.ORACLE, t)
    copies = {r.doc_id: r.taken // r.size for r in mix.itertuples() if r.size}
    enc = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    out = []
    for d, x in zip(t.doc_id, t.text):
        ids = enc.encode(enc.pieces(x))
        out += [(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())] * copies.get(d, 0)
    return sorted(out)


def test_run_against_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    want = brute(rows)
    assert got == want and len(want) > 30
    assert test_suffixes  # the fixture's brute force above is that of its rules, with whole characters


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("lang", "keep_lang")
    for name in ("kept", "row_hash", "times", "gone", "copies", "h", "block", "component_id", "size"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert name == "token_ids" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0


def test_repeats_follow_the_mix(spark):
    rows = [(i, " ".join(["x"] * (i % 9 + 1)), "en", "abc"[i % 3 and 1 + (i % 7 == 0)], 0) for i in range(90)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix(docs).toPandas()
    out = mixing.repeat(docs).toPandas()
    assert out.groupby("doc_id").size().to_dict() == {k: v for k, v in plan.groupby("doc_id").copies.sum().to_dict().items() if v}
    assert (plan.taken <= 3 * plan["size"]).all()
    by = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 5).all()


def test_one_doc_id_on_texts_of_two_groups(spark):
    say = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, say("a")), (5, say("a")), (5, say("b")), (7, say("b")), (5, ""), (None, say("a"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, say("a")), (5, say("b")), (5, ""), (None, say("a"))], key=str)
