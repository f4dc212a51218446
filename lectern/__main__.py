"""Command line: ingest, profile, evaluate.

    python -m lectern ingest ROOT TABLES [--course NAME] [--dry-run] [--force]
    python -m lectern profile ROOT
    python -m lectern evaluate GOLD ANSWERS SCORES [--out FILE]      (JSON lines of answers and scores; exit code 1 under the pass mark)
    python -m lectern quiz TABLES QUESTIONS COUNTERS ERRORS          (a quiz of every lecture: questions to be scored, as JSON lines)
    python -m lectern evaluate-quiz QUESTIONS COUNTERS ERRORS SCORES [--out FILE]   (exit code 1 under the pass mark or with errors)
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schema
from lectern.operators import catalog, evaluate
from lectern.plans import pipelines
from lectern.sources import files, store


def show(out: dict[str, DataFrame], path: str | None) -> None:
    """Print the tables of an evaluation and, with a path, write them as one JSON file."""
    for name, t in out.items():
        print(name)
        t.show(1000, truncate=False)
    if path:
        spark = next(iter(out.values())).sparkSession
        store.write_json(spark, path, pipelines.result(out))


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lectern")
    sub = parser.add_subparsers(dest="do", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("root")
    p.add_argument("tables")
    p.add_argument("--course")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--force", action="store_true")
    sub.add_parser("profile").add_argument("root")
    p = sub.add_parser("evaluate")
    for name in ("gold", "answers", "scores"):
        p.add_argument(name)
    p.add_argument("--out")
    p = sub.add_parser("quiz")
    for name in ("tables", "questions", "counters", "errors"):
        p.add_argument(name)
    p = sub.add_parser("evaluate-quiz")
    for name in ("questions", "counters", "errors", "scores"):
        p.add_argument(name)
    p.add_argument("--out")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if a.do == "ingest":
        status = pipelines.ingest(spark, a.root, a.tables, a.course, a.force, a.dry_run)
        status.show(1000, truncate=False)
        pipelines.counters(status).show()
        return 0 if status.count() else 1
    if a.do == "profile":
        found, loose = catalog.layout(files.scan(spark, a.root).select(F.col("rel_path").alias("path")))
        found.show()
        loose.show(truncate=False)
        texts, unread = files.loaded(files.discover(files.scan(spark, a.root))[0], raw=True)
        joined = texts.select("rel_path", F.when(F.col("suffix") == files.PDF, files.profile_text(F.col("pages"))).otherwise(F.get("pages", F.lit(0))).alias("text"))
        catalog.profile(joined, "rel_path", "text").show(1000, truncate=False)
        catalog.samples(joined, "rel_path", "text").show(1000, truncate=False)
        unread.show(truncate=False)
        return 0
    if a.do == "quiz":
        chunks, documents = (store.read(spark, f"{a.tables}/{n}", f) for n, f in (("chunks", schema.CHUNKS), ("documents", schema.DOCUMENTS)))
        counted, questions, errors = pipelines.quiz_scopes(chunks, documents)
        for t, path in ((questions, a.questions), (counted, a.counters), (errors, a.errors)):
            t.write.json(path)
        return 0
    if a.do == "evaluate-quiz":
        told = lambda path, fields: spark.read.schema(fields).json(path)
        questions = told(a.questions, "scope string, pos int, section string, question string")
        out = pipelines.evaluate_quizzes(told(a.counters, pipelines.QUIZ_COUNTERS), questions, told(a.scores, "scope string, pos int, faithfulness double"), told(a.errors, "scope string, error string"))
        show(out, a.out)
        return int(pipelines.quizzes_failed(out))
    answered = spark.read.schema("id string, n_claims int, not_covered string, error string").json(a.answers)
    scores = spark.read.schema("id string, " + ", ".join(f"{m} double" for m in pipelines.METRICS)).json(a.scores)
    out = pipelines.evaluate_answers(files.gold(spark, a.gold), answered, scores)
    show(out, a.out)
    return int(evaluate.failed(out["by_course"], *pipelines.METRICS))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
