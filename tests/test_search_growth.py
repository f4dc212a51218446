"""What keeps the work of a search, of its encoder and of a quiz's checks in proportion to the input."""

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import quiz, retrieval
from lectern.plans import registry


def test_blocks_fill_over_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        rows = spark.range(0, 2000, 1, 1).select("id", (F.col("id") % 20).cast("string").alias("course"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
        sizes = sorted(len(r["ids"]) // 8 for r in retrieval._blocks(rows, 64).collect())
    finally:
        spark.conf.set(key, before)
    assert sizes == [36] * 20 + [64] * 20  # two blocks a course, not one a batch and course


def test_top_k_is_exact_where_many_tie(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(0, 4, (3000, 3)).astype(float)
    table = [(i, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows = spark.createDataFrame(table, "id long, course string, vector array<double>").repartition(5)
    asked = rows.where("id % 100 < 3").withColumnRenamed("id", "query_id")
    got = {}
    for r in retrieval.top_k(asked, rows, 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    norm = np.linalg.norm(vectors, axis=1)
    for q in (i for i in range(3000) if i % 100 < 3 and norm[i]):
        mine = [i for i in range(q % 2, 3000, 2) if norm[i]]
        best = sorted(mine, key=lambda i: (-round(vectors[i] @ vectors[q] / (norm[i] * norm[q]), 10), i))[:7]
        assert [got[q][r] for r in range(1, 8)] == best, q
    assert len(got) == sum(1 for i in range(3000) if i % 100 < 3 and norm[i])


def test_encoder_runs_once_and_counts_letters(spark):
    texts = ["", None, "Tea and toast", "Kİ Über", "zzz", "e" * 300]
    rows = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "id long, course string, content string").withColumn("vector", registry.letter_counts(F.col("content")))
    low = F.lower(F.coalesce("content", F.lit("")))
    want = F.array(*((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("float") for x in registry.LETTERS))
    assert all(r["vector"] == r["want"] for r in rows.withColumn("want", want).collect())
    plan = retrieval._blocks(rows, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count(coalesce(content") == 1 and "exists" not in plan, plan


def test_text_rules_as_by_regular_expression(spark):
    odd = [chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    texts = ["", "a", "12", "a 12", "page 12345", "x٣", "7  ", *(f"{x}a{x}{x}b 3{x}" for x in odd), *odd, "a\r\nb\r\n\r\nc\n\rd\n\n", *(f"a{x}{y}b{x}" for x in odd[:10] for y in odd[:10])]
    t = spark.createDataFrame([(x,) for x in [*texts, None]], "c string")
    c = F.col("c")
    plain = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    pairs = [
        (text.strip(c), plain(c)),
        (text.lines(c), F.filter(F.transform(F.split(c, text.LINE_BREAK), plain), lambda x: x != "")),
        (text.without_page_number(c), plain(F.regexp_replace(c, r"(?U)\s*\d{1,4}\s*$", ""))),
        (text.without_page_number(plain(c), stripped=True), plain(F.regexp_replace(plain(c), r"(?U)\s*\d{1,4}\s*$", ""))),
        (text.word_count(c), F.size(F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))),
        (text.is_blank(c), plain(c) == ""),
    ]
    for r in t.select(c, *(F.struct(a.alias("a"), b.alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).collect():
        for i in range(len(pairs)):
            assert r[f"p{i}"]["a"] == r[f"p{i}"]["b"], (i, r["c"], r[f"p{i}"])


def test_text_is_cut_into_lines_once(spark):
    plan = registry.pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1, plan


def test_quotes_of_sections_owed_nothing_are_not_compared(spark):
    chosen = spark.createDataFrame([("s", 0, 0, "alpha beta"), ("s", 1, 1, "alpha beta"), ("s", 2, 0, None)], "scope string, section_index int, quota long, content string")
    asked = spark.createDataFrame([("s", i, p, q) for i in (0, 1, 2, 3) for p, q in ((0, "gamma"), (1, "alpha beta"), (2, "alpha"))], "scope string, section_index int, pos int, supporting_quote string")
    told = quiz.judged(asked, chosen)
    got = {(r["section_index"], r["pos"]): r["status"] for r in told.collect()}
    assert [got[0, p] for p in range(3)] == ["over_quota"] * 3 == [got[2, p] for p in range(3)]
    assert [got[1, p] for p in range(3)] == ["unverified", "kept", "over_quota"] and got[3, 0] == "bad_section"
    assert "quota" in (plan := told._jdf.queryExecution().optimizedPlan().toString()) and "> 0)" in plan, plan


def test_questions_of_many_files_share_blocks(spark, monkeypatch):
    seen = []
    real = retrieval._blocks
    monkeypatch.setattr(retrieval, "_blocks", lambda df, size: (seen.append(real(df, size)), seen[-1])[1])
    vectors = spark.range(0, 400, 1, 20).select("id", F.lit("c").alias("course"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    assert retrieval.top_k(vectors.withColumnRenamed("id", "query_id"), vectors, 3).count() == 1200
    assert seen[0].count() <= retrieval.QUERY_SALT  # not one a file, each of which would meet every block of rows
