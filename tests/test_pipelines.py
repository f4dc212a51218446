"""Files to tables to answers and quizzes, with stand-in models."""

import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import models
from lectern.operators import catalog
from lectern.plans import pipelines
from lectern.service import Service, handler
from lectern.sources import files, store
from lectern.streaming import ingest as streaming

DIM = 64


def page(title, topic):
    return f"{title}\n{topic} is the topic of this slide and it explains {topic} in some words.\nMore about {topic} and why {topic} matters to the exam of the course."


def reader():
    """Pages divided by form feeds stand for a PDF."""
    return lambda data: data.decode().split("\f")


@pytest.fixture()
def corpus(tmp_path):
    root = tmp_path / "raw"
    (root / "CS1/week").mkdir(parents=True)
    (root / "CS2").mkdir()
    deck = [f"Lecture 5 : Nets\n{page('x', 'networks')}", "Outline\nConvolution", page("Kernels", "convolution"), page("Pooling", "pooling"), "Agenda\nTraining", page("Descent", "gradients")]
    (root / "CS1/week/slides5.pdf").write_text("\f".join(deck))
    (root / "CS1/copy_slides.pdf").write_text("\f".join(deck))
    (root / "CS1/notes.md").write_text("some notes")
    (root / "CS1/.hidden.md").write_text("x")
    (root / "CS1/picture.png").write_bytes(b"\x89")
    (root / "CS1/blank_slides.txt").write_text(" \n")
    (root / "loose.txt").write_text("no course")
    (root / "CS2/lecture_old.txt").write_bytes(b"\xff " + page("Sorting", "quicksort").encode())
    return root


def run(spark, root, tables, **how):
    return {r["rel_path"]: (r["status"], r["detail"]) for r in pipelines.ingest(spark, str(root), str(tables), reader=reader, dim=DIM, **how).collect()}


def test_ingest(spark, corpus, tmp_path):
    tables = tmp_path / "tables"
    dry = run(spark, corpus, tables, dry_run=True)
    assert not tables.exists() and dry["CS1/week/slides5.pdf"] == ("ingested", "4 chunks")
    got = run(spark, corpus, tables)
    assert got == {
        "CS1/copy_slides.pdf": ("ingested", "4 chunks"), "CS1/week/slides5.pdf": ("skipped", "same bytes already ingested as copy_slides.pdf"), "CS1/notes.md": ("skipped", "no chunking strategy for this document type"),
        "CS1/picture.png": ("skipped", "unsupported file type"), "CS1/blank_slides.txt": ("skipped", "no text; likely a scan"), "loose.txt": ("skipped", "no course directory"), "CS2/lecture_old.txt": ("ingested", "1 chunks"),
    }
    docs, chunks = store.read(spark, f"{tables}/documents", schema.DOCUMENTS), store.read(spark, f"{tables}/chunks", schema.CHUNKS)
    assert {(r["course"], r["doc_path"], r["lecture"]) for r in docs.collect()} == {("CS1", "copy_slides.pdf", "Lecture 5"), ("CS2", "lecture_old.txt", None)}
    assert [r["section"] for r in chunks.where("course = 'CS1'").orderBy("ordinal").collect()] == [None, "Convolution", "Convolution", "Training"]
    assert {r["models"] for r in store.embedding_models(chunks).collect()} == {1}
    assert all(s == "skipped" for p, (s, _) in run(spark, corpus, tables).items())
    first = {r["doc_path"]: r["ingested_at"] for r in docs.collect()}
    (corpus / "CS1/copy_slides.pdf").write_text(page("Only", "one thing"))
    again = run(spark, corpus, tables, force=True)
    assert again["CS1/copy_slides.pdf"] == ("ingested", "1 chunks")
    assert store.read(spark, f"{tables}/chunks", schema.CHUNKS).where("course = 'CS1'").groupBy("document_id").count().orderBy("count").first()["count"] == 1
    assert {r["doc_path"]: r["ingested_at"] for r in store.read(spark, f"{tables}/documents", schema.DOCUMENTS).collect()}["copy_slides.pdf"] == first["copy_slides.pdf"]
    assert files.scan(spark, str(tmp_path / "missing")).count() == 0


@pytest.fixture()
def tables(spark, corpus, tmp_path):
    run(spark, corpus, tmp_path / "tables")
    return str(tmp_path / "tables")


def load(spark, tables):
    return store.read(spark, f"{tables}/chunks", schema.CHUNKS), store.read(spark, f"{tables}/documents", schema.DOCUMENTS)


def test_ask(spark, tables):
    chunks, docs = load(spark, tables)
    asked = spark.createDataFrame([(1, "CS1", "what is convolution", None), (2, "CS1", "zebra", None), (3, "CS1", "what is convolution", "Lecture 6"), (4, "CS9", "convolution", None), (5, "CS1", "why gradients matter", "Lecture 5")], "query_id long, course string, question string, lecture string")
    got = {r["query_id"]: r for r in pipelines.ask(asked, chunks, docs, models.embedder(dim=DIM)).collect()}
    assert got[1]["n_claims"] > 0 and "[copy_slides.pdf | Lecture 5 | Convolution" in got[1]["citations"]
    assert all(got[i]["n_claims"] == 0 and got[i]["not_covered"] == schema.NO_CONTEXT for i in (2, 3, 4))
    assert "Training" in got[5]["citations"] and got[5]["not_covered"] == ""


def test_quiz(spark, tables):
    chunks, docs = load(spark, tables)
    questions, counters = pipelines.make_quiz("CS1", "Lecture 5", chunks, docs, 4)
    c = counters.first()
    assert (c["n_kept"], c["sections_covered"], c["sections_available"], c["coverage"], c["quote_validity"], c["n_topup_rounds"]) == (4, 3, 3, 1.0, 1.0, 0)
    assert {r["citation"] for r in questions.collect()} >= {"[copy_slides.pdf | Lecture 5 | Training]"}
    with pytest.raises(ValueError):
        pipelines.make_quiz("CS1", None, chunks, docs, 26)
    with pytest.raises(LookupError):
        pipelines.make_quiz("CS9", None, chunks, docs)

    def forgetful():
        """Writes for the first section only, and once with an invented quote."""
        said = []

        def answer(system, user, temperature):
            said.append(user)
            good = json.loads(models.extractive_quiz()(system, user, temperature))["questions"]
            if pipelines.ASKED_BEFORE in user:
                return json.dumps({"questions": good})
            return json.dumps({"questions": [good[0], {**good[-1], "supporting_quote": "invented evidence entirely"}, {**good[0], "section_index": 77}]})

        return answer

    _, counters = pipelines.make_quiz("CS1", None, chunks, docs, 3, forgetful)
    c = counters.first()
    assert (c["n_generated"], c["n_kept"], c["n_dropped_unverified"], c["n_dropped_bad_section"], c["n_topup_rounds"]) == (5, 3, 1, 1, 1)


def test_generation_is_retried_once(spark):
    def flaky():
        calls = []

        def answer(system, user, temperature):
            calls.append(user)
            return '{"ok": 1}' if "was not valid" in user and "never" not in user else "broken"

        return answer

    got = {r["query_id"]: r for r in models.generate(spark.createDataFrame([(1, "once"), (2, "never")], "query_id long, prompt string"), flaky, "").collect()}
    assert got[1]["raw"] == '{"ok": 1}' and got[2]["raw"] is None and got[2]["error"]


def test_service(spark, tables):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(Service(spark, tables, dim=DIM)))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert call("/")[0] == 200 and call("/nothing")[0] == 404
    status, body = call("/api/courses")
    assert status == 200 and [(c["course"], c["chunks"]) for c in json.loads(body)] == [("CS1", 4), ("CS2", 1)]
    assert call("/api/ask", {"course": "CS1", "question": "what is pooling"})[0] == 200
    assert call("/api/ask", {"course": "", "question": "what"})[0] == 422
    assert call("/api/quiz", {"course": "CS1", "n_questions": 2})[0] == 200
    assert call("/api/quiz", {"course": "CS9"})[0] == 404 and call("/api/quiz", {"course": "CS1", "n_questions": 26})[0] == 422
    assert Service(None, tables).courses()[0] == 503
    server.shutdown()


def test_catalog_order(spark, tables):
    chunks, docs = load(spark, tables)
    listed = catalog.listing(docs, chunks)
    assert [r["doc_path"] for r in listed.collect()] == ["copy_slides.pdf", "lecture_old.txt"]
    assert [r["lecture"] for r in catalog.lectures(listed, "CS1").collect()] == ["Lecture 5"]


def test_stream(spark, tmp_path):
    source, tables = tmp_path / "pages", tmp_path / "stream"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(json.dumps(dict(zip(("document_id", "course", "page", "text"), r))) for r in rows))
    put("1.json", [(1, "c", 1, page("A", "alpha")), (1, "c", 2, page("B", "beta")), (2, "c", 1, page("C", "gamma"))])
    streaming.follow(streaming.pages(spark, str(source)), str(tables), str(tmp_path / "cp"), dim=DIM).awaitTermination(120)
    assert store.read(spark, f"{tables}/chunks", schema.CHUNKS).count() == 3
    put("2.json", [(1, "c", 1, page("D", "delta"))])
    streaming.follow(streaming.pages(spark, str(source)), str(tables), str(tmp_path / "cp"), dim=DIM).awaitTermination(120)
    got = store.read(spark, f"{tables}/chunks", schema.CHUNKS)
    # Page 1 of document 1 is replaced, its page 2 stays.
    assert got.count() == 3 and got.where(F.col("content").contains("delta")).count() == 1 and got.where(F.col("content").contains("beta")).count() == 1 and not got.where(F.col("content").contains("alpha")).count()
