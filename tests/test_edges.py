"""Cases in which rows were lost, kept or ordered wrongly, and failures that must show."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import models, text
from lectern.operators import evaluate, retrieval
from lectern.plans import pipelines
from lectern.service import Service
from lectern.sources import files, shared, store
from tests.test_pipelines import DIM, corpus, load, reader, run, tables  # noqa: F401

VECTORS = "id long, course string, vector array<double>"


def test_vectors_without_direction(spark):
    rows = spark.createDataFrame([(1, "c", [1.0, 0.0]), (2, "c", [0.0, 0.0]), (3, "c", None), (4, "c", [float("nan"), 1.0]), (5, "c", [1.0, None]), (6, "c", [1.0, 0.0, 0.0]), (7, "c", []), (8, "c", [1e300, 1e300]), (9, None, [1.0, 0.0])], VECTORS)
    asked = spark.createDataFrame([(10, "c", [1.0, 0.0]), (11, "c", [0.0, 0.0]), (12, "c", None), (13, "d", [1.0, 0.0])], VECTORS).withColumnRenamed("id", "query_id")
    got = sorted((r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in retrieval.top_k(asked, rows).collect())
    assert got == [(10, 1, 1.0, 1), (10, 8, 0.707107, 2)]
    assert retrieval.top_k(asked, rows.limit(0)).count() == 0


def test_only_asked_courses_are_read(spark, tables):
    chunks, docs = load(spark, tables)
    asked = spark.createDataFrame([(1, "CS1", "what is convolution")], "query_id long, course string, question string")
    embed = models.embedder(dim=DIM)
    plan = retrieval.retrieve(asked, chunks, docs, embed, models.overlap_score)._jdf.queryExecution().executedPlan().toString()
    assert "course" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def chunk(document, course, ordinal, content):
    return (document, course, None, ordinal, 1, content, 2, [0.5], "m", None, None)


def test_commit(spark, tmp_path):
    root = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(list(rows), schema.CHUNKS)
    read = lambda: {(r["course"], r["content"]) for r in store.read(spark, f"{root}/chunks", schema.CHUNKS).collect()}
    assert read() == set()
    store.commit(spark, root, ["a", "b x=/%"], chunks=make(chunk(1, "a", 0, "one"), chunk(2, "b x=/%", 0, "two")))
    assert read() == {("a", "one"), ("b x=/%", "two")}
    store.commit(spark, root, ["a"], chunks=make())
    assert read() == {("b x=/%", "two")}, "a course that becomes empty keeps nothing"
    before = store.read(spark, f"{root}/chunks", schema.CHUNKS)
    store.commit(spark, root, ["b x=/%"], chunks=make(chunk(2, "b x=/%", 0, "three")))
    assert read() == {("b x=/%", "three")} and before.first()["content"] == "two", "a reader that began before keeps its state"
    for i in range(3):
        store.commit(spark, root, ["a"], chunks=make(chunk(1, "a", 0, f"v{i}")))
    assert read() == {("b x=/%", "three"), ("a", "v2")}
    assert len(list((tmp_path / "t" / "chunks" / "course=a").iterdir())) == 2


def test_commits_at_once(spark, tmp_path):
    root = str(tmp_path / "t")
    held = store._Files(spark, root)
    held.put(f"{root}/{store.LOG}/{1:012d}.json", "{}")
    with pytest.raises(Exception, match="exists"):
        held.put(f"{root}/{store.LOG}/{1:012d}.json", '{"other": []}')
    assert store._current(held, root) == (1, {})


def test_names_that_are_not_hidden(spark, tmp_path):
    for name in ("a.md", "_slides.md", "_d/x.md", ".h/y.md", "_d/.z.md", ".h/_w/_v.md", "c/.w.md", "c d/[e]/_f.txt", "_g[1]/h.txt", "_d/_e/i.md"):
        (tmp_path / "raw" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / name).write_text(name)
    got = {r["rel_path"]: bytes(r["content"]).decode() for r in files.scan(spark, str(tmp_path / "raw")).collect()}
    assert set(got) == {"a.md", "_slides.md", "_d/x.md", ".h/y.md", ".h/_w/_v.md", "c d/[e]/_f.txt", "_g[1]/h.txt", "_d/_e/i.md"} and all(k == v for k, v in got.items())


def broken():
    return lambda system, user, temperature: "no JSON"


def test_failed_generation_shows(spark, tables):
    chunks, docs = load(spark, tables)
    asked = spark.createDataFrame([(1, "CS1", "what is convolution"), (2, "CS1", "zebra")], "query_id long, course string, question string")
    got = {r["query_id"]: r for r in pipelines.ask(asked, chunks, docs, models.query_embedder(dim=DIM), generator=broken).collect()}
    assert got[1]["error"] and got[1]["n_claims"] == 0 and got[1]["not_covered"] == ""
    assert got[2]["error"] is None and got[2]["not_covered"] == schema.NO_CONTEXT
    service = Service(spark, tables, dim=DIM, answers=broken, quizzes=broken)
    assert service.ask({"course": "CS1", "question": "what is convolution"})[0] == 502
    assert service.quiz({"course": "CS1"})[0] == 502
    with pytest.raises(RuntimeError):
        pipelines.make_quiz("CS1", None, chunks, docs, generator=broken)


def test_answer_is_whole(spark, tables):
    def full():
        def answer(system, user, temperature):
            assert "supporting_quote" in system
            return json.dumps({**json.loads(models.extractive_answers()(system, user, temperature)), "analogy": "like a sieve", "check_yourself": ["why?"], "exam_angle": None})

        return answer

    status, body = Service(spark, tables, dim=DIM, answers=full).ask({"course": "CS1", "question": "what is convolution"})
    assert status == 200 and body["analogy"] == "like a sieve" and body["check_yourself"] == ["why?"] and body["exam_angle"] is None
    assert body["claims"] and all(c["citation"].startswith("[") and c["text"] for c in body["claims"]) and body["passages"][0]["content"]


def test_answers_are_checked_by_schema(spark):
    valid = models.conforms(schema.ANSWER)
    good = {"claims": [{"text": "a", "passage_index": 0, "supporting_quote": "b"}]}
    assert valid(json.dumps(good)) == good
    for bad in ({}, {"claims": 1}, {"claims": [{"text": "a"}]}, {"claims": [{**good["claims"][0], "passage_index": "0"}]}, {**good, "analogy": 3}, []):
        with pytest.raises(ValueError):
            valid(json.dumps(bad))


def test_question_prefix(spark):
    t = spark.createDataFrame([("what is it",)], "q string")
    plain, told = models.symmetric_embedder(dim=DIM), models.query_embedder(dim=DIM)
    same = models.embedder(dim=DIM)
    row = t.select(plain(F.col("q")).alias("a"), told(F.col("q")).alias("b"), same(F.concat(F.lit(models.QUERY_PREFIX), "q")).alias("c")).first()
    assert row["a"] != row["b"] and row["b"] == row["c"]


def test_ingest_with_a_tokenizer(spark, corpus, tmp_path):
    got = run(spark, corpus, tmp_path / "t", count_tokens=lambda s: s.str.len())
    assert got["CS1/copy_slides.pdf"][0] == "ingested"
    held = store.read(spark, f"{tmp_path}/t/chunks", schema.CHUNKS)
    assert held.where(F.col("token_count") != F.length("content")).count() == 0 and held.count() > 0


def test_numbered(spark):
    t = spark.createDataFrame([(i * 7919 % 1000, i % 3 if i % 5 else None) for i in range(1000)], "k long, x long")
    got = sorted((r["n"], r["x"], r["k"]) for r in shared.numbered(t, "n", F.asc_nulls_first("x"), F.col("k")).collect())
    want = sorted(((r[0], r[1]) for r in t.select("x", "k").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(i + 1, x, k) for i, (x, k) in enumerate(want)]
    assert shared.numbered(t.limit(0), "n", F.col("k")).count() == 0


def test_quote_support_edges(spark):
    t = spark.createDataFrame([(None, "a"), ("a", None), ("", "a"), ("a a b c", "x a y"), ("a a a b", "x a y"), ("A, b", "a b")], "q string, s string")
    assert [r[0] for r in t.select(text.quote_supported(F.col("q"), F.col("s"))).collect()] == [None, None, False, False, True, True]


def test_quiz_evaluation(spark, tables, tmp_path):
    chunks, docs = load(spark, tables)
    docs = docs.withColumn("lecture", F.coalesce("lecture", F.when(F.col("course") == "CS2", "Lecture 9")))

    def once():
        good = models.extractive_quiz()

        def answer(system, user, temperature):
            if "Lecture 9" in user:
                raise OSError("no connection")
            return good(system, user, temperature)

        return answer

    counted, questions, errors = pipelines.quiz_scopes(chunks, docs, 4, once)
    assert [r["scope"] for r in counted.collect()] == ["CS1 / Lecture 5"] and "no connection" in errors.first()["error"]
    rows = questions.collect()
    assert len(rows) == 4 and all(r["answer"] in r["context"] for r in rows)
    scores = spark.createDataFrame([("CS1 / Lecture 5", 0, 0.9), ("CS1 / Lecture 5", 1, 0.5), ("CS1 / Lecture 5", 2, float("nan"))], "scope string, pos int, faithfulness double")
    out = pipelines.evaluate_quizzes(counted, questions, scores, errors)
    row = out["by_scope"].first()
    assert (row["faithfulness"], row["faithfulness_scored"], row["n_kept"]) == (0.7, 2, 4)
    assert [r["faithfulness"] for r in out["per_question"].collect()] == [None, None, 0.5, 0.9]
    assert pipelines.quizzes_failed(out)
    fine = {**out, "errors": errors.limit(0), "by_scope": out["by_scope"].withColumn("faithfulness", F.lit(0.8))}
    assert not pipelines.quizzes_failed(fine)
    store.write_json(spark, str(tmp_path / "r.json"), pipelines.result(out, judge="none"))
    told = json.loads((tmp_path / "r.json").read_text())
    assert told["threshold"] == schema.PASS_MARK and told["judge"] == "none" and len(told["per_question"]) == 4
    missing = evaluate.with_section_texts(questions.drop("context").withColumn("section_key", F.lit("none")), spark.createDataFrame([], "key string, content string"))
    assert {r["context"] for r in missing.collect()} == {""}
    with pytest.raises(ValueError):
        pipelines.evaluate_quizzes(counted, questions.limit(0), scores, errors)


def test_profile_of_raw_text(spark, corpus):
    texts, unread = files.loaded(files.discover(files.scan(spark, str(corpus)))[0], reader, raw=True)
    got = {r["rel_path"]: r["pages"] for r in texts.collect()}
    assert got["CS1/blank_slides.txt"] == [" \n"] and unread.count() == 0
