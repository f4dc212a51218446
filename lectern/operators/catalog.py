"""What the corpus holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text


def listing(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """course, doc_path, lecture, chunks of every document, also those without chunks."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    t = documents.select("id", "course", "doc_path", "lecture").join(counts, F.col("id") == F.col("document_id"), "left")
    return t.groupBy("course", "doc_path", "lecture").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")).orderBy("course", F.asc_nulls_last("lecture"), "doc_path")


def courses(listed: DataFrame) -> DataFrame:
    """course, chunks, documents: the documents of each course in order, as structs."""
    row = F.struct(F.col("lecture").isNull().alias("last"), "lecture", "doc_path", "chunks")
    t = listed.groupBy("course").agg(F.sum("chunks").alias("chunks"), F.sort_array(F.collect_list(row)).alias("d"))
    return t.select("course", "chunks", F.transform("d", lambda x: F.struct(x["doc_path"].alias("doc_path"), x["lecture"].alias("lecture"), x["chunks"].alias("chunks"))).alias("documents"))


def scopes(documents: DataFrame) -> DataFrame:
    return documents.where("lecture IS NOT NULL").select("course", "lecture").distinct().orderBy("course", "lecture")


def lectures(listed: DataFrame, course: str | None = None) -> DataFrame:
    """The lectures of a course, in order; without one, course and lecture of all."""
    named = listed.where(F.col("lecture") != "")
    if course is None:
        return named.select("course", "lecture").distinct().orderBy("course", "lecture")
    return named.where(F.col("course") == course).select("lecture").distinct().orderBy("lecture")


def _matching(pattern: str):
    return lambda x: x.rlike(pattern)


def _sample(kind: str):
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("n"), F.substring(x, 1, 88).alias("line"))


def profile(texts: DataFrame, key: str, body: str) -> DataFrame:
    """key, chars, stripped_chars, words, lines, blank_lines, and a count of each line pattern."""
    stripped = F.regexp_replace(body, text.FORMULA, " [FORMULA] ")
    t = texts.select(key, F.length(body).cast("long").alias("chars"), stripped.alias("t"))
    all_lines = F.split("t", text.LINE_BREAK)
    # A final line break opens no further line.
    all_lines = F.when(F.element_at(all_lines, -1) == "", F.slice(all_lines, 1, F.size(all_lines) - 1)).otherwise(all_lines)
    t = t.withColumn("l", F.transform(all_lines, text.strip))
    counts = [F.size(F.filter("l", _matching(p))).cast("long").alias(name) for name, p in text.LINE_PATTERNS.items()]
    return t.select(key, "chars", F.length("t").cast("long").alias("stripped_chars"), text.word_count(F.col("t")).cast("long").alias("words"), F.size("l").cast("long").alias("lines"), F.size(F.filter("l", lambda x: x == "")).cast("long").alias("blank_lines"), *counts)


def samples(texts: DataFrame, key: str, body: str, first: int = 15, matches: int = 4) -> DataFrame:
    """key, kind, n, line: the first lines that are not blank, and the first matches of each pattern, cut to 88 characters."""

    def picked(lines: Column) -> Column:
        parts = [F.transform(F.slice(lines, 1, first), _sample("first"))]
        for name, p in text.LINE_PATTERNS.items():
            parts.append(F.transform(F.slice(F.filter(lines, _matching(p)), 1, matches), _sample(name)))
        return F.concat(*parts)

    # The lines are bound as an element, so that they are split once and not for each pattern.
    lines = text.lines(F.regexp_replace(body, text.FORMULA, " [FORMULA] "))
    return texts.select(key, F.explode(F.get(F.transform(F.array(lines), picked), F.lit(0))).alias("s")).select(key, "s.*")


def layout(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Courses of relative paths, and the files that lie in none."""
    deep = paths.withColumn("parts", F.split("path", "/"))
    return deep.where(F.size("parts") > 1).select(F.get("parts", F.lit(0)).alias("course")).distinct(), deep.where(F.size("parts") == 1).select("path")
