"""The question and quiz service: plain functions with HTTP status codes, and a small HTTP front.

    python -m lectern.service TABLES [PORT]
"""

from __future__ import annotations

import json
import logging
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from lectern import schema
from lectern.functions import models
from lectern.operators import catalog
from lectern.plans import pipelines
from lectern.sources import store

log = logging.getLogger(__name__)

PAGE = (Path(__file__).parent / "page.html").read_text() if (Path(__file__).parent / "page.html").exists() else "<!doctype html><title>lectern</title>"


class Service:
    """Answers requests from the tables below a path. Every call gives (status, body)."""

    def __init__(self, spark: SparkSession | None, tables: str, embed=None, dim: int = schema.EMBED_DIM, answers=models.extractive_answers, quizzes=models.extractive_quiz):
        self.spark, self.tables, self.answers, self.quizzes = spark, tables, answers, quizzes
        self.embed = embed or (models.query_embedder(dim=dim) if spark is not None else None)

    def _documents(self):
        return store.read(self.spark, f"{self.tables}/documents", schema.DOCUMENTS)

    def _chunks(self):
        return store.read(self.spark, f"{self.tables}/chunks", schema.CHUNKS)

    def courses(self) -> tuple[int, object]:
        if self.spark is None:
            return 503, {"detail": "not ready"}
        rows = catalog.courses(catalog.listing(self._documents(), self._chunks())).orderBy("course").collect()
        return 200, [r.asDict(recursive=True) for r in rows]

    def ask(self, body: dict) -> tuple[int, object]:
        course, question, lecture = body.get("course"), body.get("question"), body.get("lecture")
        if not isinstance(course, str) or not course or not isinstance(question, str) or not 3 <= len(question) <= 500:
            return 422, {"detail": "course and a question of 3 to 500 characters are required"}
        if self.spark is None:
            return 503, {"detail": "not ready"}
        try:
            asked = self.spark.createDataFrame([(0, course, question, lecture)], "query_id long, course string, question string, lecture string")
            row = pipelines.ask(asked, self._chunks(), self._documents(), self.embed, generator=self.answers).first().asDict(recursive=True)
            if row["error"] is not None:
                raise RuntimeError(row["error"])
            return 200, {"question": question, "course": course, "lecture": lecture, **{k: v for k, v in row.items() if k not in ("query_id", "error")}}
        except Exception:  # noqa: BLE001 - details go to the log only
            log.exception("ask failed")
            return 502, {"detail": "generation failed"}

    def quiz(self, body: dict) -> tuple[int, object]:
        course, n = body.get("course"), body.get("n_questions", schema.DEFAULT_QUESTIONS)
        if not isinstance(course, str) or not course or not isinstance(n, int) or not 1 <= n <= schema.MAX_QUESTIONS:
            return 422, {"detail": f"a course and 1 to {schema.MAX_QUESTIONS} questions are required"}
        if self.spark is None:
            return 503, {"detail": "not ready"}
        try:
            questions, counters = pipelines.make_quiz(course, body.get("lecture"), self._chunks(), self._documents(), n, self.quizzes)
            return 200, {**counters.first().asDict(), "questions": [r.asDict() for r in questions.orderBy("round", "pos").collect()]}
        except LookupError as e:
            return 404, {"detail": str(e)}
        except Exception:  # noqa: BLE001
            log.exception("quiz failed")
            return 502, {"detail": "generation failed"}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path == "/":
                self._send(200, PAGE.encode(), "text/html; charset=utf-8")
                return
            status, body = service.courses() if self.path == "/api/courses" else (404, {"detail": "not found"})
            self._send(status, json.dumps(body).encode())

        def do_POST(self) -> None:
            call = {"/api/ask": service.ask, "/api/quiz": service.quiz}.get(self.path)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                status, out = call(body) if call and isinstance(body, dict) else (404 if call is None else 422, {"detail": "not found" if call is None else "an object is required"})
            except ValueError:
                status, out = 422, {"detail": "not JSON"}
            self._send(status, json.dumps(out).encode())

        def log_message(self, *args) -> None:
            log.info(*args)

    return Handler


def main(tables: str, port: int = 8000) -> None:
    spark = SparkSession.builder.appName("lectern").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    ThreadingHTTPServer(("127.0.0.1", port), handler(Service(spark, tables))).serve_forever()


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
