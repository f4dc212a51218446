"""Scoped top-k search, reranking, gating and expansion of hits to passages, for batches of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schema
from lectern.functions import text

#: Vectors of one packed block, and bytes that wait in a task for their blocks to fill.
QUERY_BLOCK, ROW_BLOCK, WAITING = 512, 8192, 32 << 20
#: Rows that are compared with a block of queries at once.
SLICE = 1024
#: Tasks that the rows of one course fall to, at least, and those that pack its queries.
SALT, QUERY_SALT = 32, 4
#: Results that a task holds at most before it hands them on.
RESULTS = 1 << 21
#: Courses that are named in the plan, so that their folders alone are read; more are found by a semi-join.
PRUNED = 1000


def scoped(chunks: DataFrame, course: str, lecture: str | None = None) -> DataFrame:
    """Rows of one course, and of one lecture if given. There is no search without a course."""
    if not course:
        raise ValueError("a course is required")
    out = chunks.where(F.col("course") == course)
    return out if lecture is None else out.where(F.col("lecture") == lecture)


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """course, width, ids, vectors: unit vectors packed into blocks of at most `size` of one course and length, filled over the batches of a task."""
    kind = df.schema["course"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[tuple, int] = {}
        held = 0

        def block(key: tuple, least: int) -> Iterator[pa.RecordBatch]:
            """Blocks of what waits for this key; a rest of fewer than `least` goes on waiting."""
            nonlocal held
            ids, rows = (np.concatenate(x) for x in zip(*waiting.pop(key), strict=True))
            held -= rows.nbytes
            for lo in range(0, len(ids), size):
                some, part = ids[lo : lo + size], rows[lo : lo + size]
                if len(some) < least:
                    waiting[key], count[key] = [(some.copy(), part.copy())], len(some)
                    held += part.nbytes
                    return
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], course_type), pa.array([key[1]], pa.int64()), pa.array([some.tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())], names=["course", "width", "ids", "vectors"])
            count.pop(key)

        for b in batches:
            b = b.filter(b["vector"].is_valid())
            flat = np.ascontiguousarray(b["vector"].flatten().to_numpy(zero_copy_only=False), np.float64)
            lengths = pa.compute.list_value_length(b["vector"]).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(lengths) - lengths
            ids = b["id"].to_numpy().astype(np.int64)
            courses, course_type = b["course"].dictionary_encode(), b["course"].type
            code, names = courses.indices.to_numpy(zero_copy_only=False), courses.dictionary.to_pylist()
            order = np.lexsort((lengths, code))
            ends = np.flatnonzero(np.diff(code[order]) | np.diff(lengths[order])) + 1
            for mine in np.split(order, ends) if len(order) else ():
                n = int(lengths[mine[0]])
                rows = flat[begin[mine][:, None] + np.arange(n)]
                # A direction is needed: zero vectors, and vectors with a null, infinite or undefined component, find nothing and are not found.
                sound = np.isfinite(rows).all(1) & (rows != 0).any(1)
                if not sound.any():
                    continue
                rows = rows[sound]
                rows /= np.abs(rows).max(1, keepdims=True)  # first, so that no square overflows or vanishes
                rows /= np.sqrt((rows * rows).sum(1, keepdims=True))
                key = (names[code[mine[0]]], n)
                waiting.setdefault(key, []).append((ids[mine][sound], rows))
                count[key] = count.get(key, 0) + len(rows)
                held += rows.nbytes
                if count[key] >= size:
                    yield from block(key, size)
            if held > WAITING:
                for key in list(waiting):
                    yield from block(key, 1)
        for key in list(waiting):
            yield from block(key, 1)

    v = F.col("vector")
    v = v if isinstance(df.schema["vector"].dataType.elementType, T.FloatType | T.DoubleType) else v.cast("array<double>")
    # Whether a vector is sound is tested in pack: a filter here would have Spark make the vectors of an encoder twice.
    rows = df.where("course IS NOT NULL AND id IS NOT NULL").select("course", "id", v.alias("vector"))
    return rows.mapInArrow(pack, T.StructType([T.StructField("course", kind), T.StructField("width", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())]))


def _merged(score: np.ndarray, ids: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
    """Put what is better into the best rows so far (who, with cosines best), by cosines to ten digits, then ids; both in place."""
    k = best.shape[1]
    floor = np.round(best[:, -1], 10)
    if score.shape[1] > 4 * k and np.isneginf(floor).any():
        # The k-th of the maxima of groups of rows is reached by k rows.
        tops = np.maximum.reduceat(score, np.arange(0, score.shape[1], score.shape[1] // (2 * k)), axis=1)
        floor = np.maximum(floor, np.round(np.partition(tops, -k, axis=1)[:, -k], 10))
    q, at = np.nonzero(score >= floor[:, None] - 1e-10)
    found, own = score[q, at], ids[at]
    digits = np.round(found, 10)
    last = np.round(best[:, -1], 10)[q]
    better = (digits > last) | (digits == last) & (own < who[q, -1])
    q, found, own = q[better], found[better], own[better]
    if not len(q):
        return
    touched = np.unique(q)
    q, found, own = np.concatenate([q, np.repeat(touched, k)]), np.concatenate([found, best[touched].ravel()]), np.concatenate([own, who[touched].ravel()])
    order = np.lexsort((own, -np.round(found, 10), q))
    first = np.searchsorted(q[order], touched)  # at least the k rows from before are there
    keep = order[first[:, None] + np.arange(k)]
    best[touched], who[touched] = found[keep], own[keep]


def top_k(queries: DataFrame, rows: DataFrame, k: int = schema.TOP_K) -> DataFrame:
    """query_id, id, score, rank: the k rows of each query's course with the highest cosine, ties by id.

    queries: query_id, course, vector; rows: id, course, vector. Cosines are ranked to ten digits, so that equal
    vectors tie wherever they are compared. Vectors without a direction, or of another length, are no results.

    Both sides are packed into blocks: rows where they are read, queries after an exchange by course, so that their blocks are
    full. Blocks of one course meet in an equi-join that is salted: a course's rows fall to SALT tasks, each with a copy of
    the few blocks of queries. A pair of blocks is a matrix product, of which only what beats a query's k best rows so far is
    looked at; a task returns k rows a query, whatever the number of blocks.
    """
    asked = queries.select(F.col("query_id").alias("id"), "course", "vector").repartition("course", F.pmod(F.xxhash64("id"), F.lit(QUERY_SALT)))
    asked = _blocks(asked, QUERY_BLOCK)
    held = _blocks(rows.select("id", "course", "vector"), ROW_BLOCK).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALT)))
    asked = asked.withColumnsRenamed({"ids": "q", "vectors": "qv"}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
    # Rows stream past the queries, which are the fewer and the ones that a merge join keeps in memory.
    pairs = held.join(asked, ["course", "width", "salt"]).select("q", "qv", "ids", "vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (q, _), (best, who) in state.items():
                there = ~np.isneginf(best)
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(np.frombuffer(q, np.int64), there.sum(1)), "id": who[there], "score": best[there]})
            state.clear()

        for b in batches:
            for q, qv, ids, vectors in zip(*(b[c].to_pylist() for c in ("q", "qv", "ids", "vectors")), strict=True):
                n, ids = len(q) // 8, np.frombuffer(ids, np.int64)
                a, v = np.frombuffer(qv).reshape(n, -1), np.frombuffer(vectors).reshape(len(ids), -1)
                if (q, qv) not in state:
                    if size + n * k > RESULTS:
                        yield from told()
                        size = 0
                    state[q, qv] = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
                    size += n * k
                for lo in range(0, len(ids), SLICE):
                    _merged(a @ v[lo : lo + SLICE].T, ids[lo : lo + SLICE], *state[q, qv])
        yield from told()

    found = pairs.mapInArrow(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def reranked(hits: DataFrame, score: Column) -> DataFrame:
    """hits with score replaced and rank anew; ties keep the order of the search."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "search_rank"))
    return hits.withColumn("search_rank", F.col("rank")).withColumn("score", score).withColumn("rank", rank)


def gated(hits: DataFrame, floor: float = schema.MIN_RERANK_SCORE, share: float = schema.RELATIVE_FLOOR) -> DataFrame:
    """Hits that reach the floor and the share of their query's best score."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("cut", F.greatest(F.lit(floor), top * share)).where(F.col("score") >= F.col("cut")).drop("cut")


def spans(hits: DataFrame, chunks: DataFrame, radius: int = schema.WINDOW_RADIUS) -> DataFrame:
    """query_id, rank, ordinal, page, content: the chunks of each hit's section, or its neighbours where it has none.

    hits: query_id, rank, document_id, section, ordinal.
    """
    own = hits.select("query_id", "rank", "document_id", "section", F.col("ordinal").alias("at"))
    part = chunks.select("document_id", "section", "ordinal", "page", "content")
    whole = own.where("section IS NOT NULL").join(part, ["document_id", "section"])
    # A window of known width is an equi-join on its few ordinals rather than a range join.
    near = own.where("section IS NULL").drop("section").withColumn("ordinal", F.explode(F.sequence(F.col("at") - radius, F.col("at") + radius))).join(part.drop("section"), ["document_id", "ordinal"])
    cols = ("query_id", "rank", "ordinal", "page", "content")
    return whole.select(*cols).unionByName(near.select(*cols))


def passages(hits: DataFrame, chunks: DataFrame, most: int = schema.MAX_PASSAGES) -> DataFrame:
    """query_id, passage (from 0), course, doc_path, lecture, section, pages, content, score.

    Hits in rank order become passages; the same span of a document counts once, with its best hit.
    hits: query_id, rank, score, course, document_id, doc_path, lecture, section, ordinal.
    """
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "page", "content")))
    held = spans(hits, chunks).groupBy("query_id", "rank").agg(rows.alias("rows"))
    full = hits.join(held, ["query_id", "rank"]).withColumn("span", F.transform("rows", lambda r: r["ordinal"]))
    best = F.row_number().over(Window.partitionBy("query_id", "document_id", "span").orderBy("rank"))
    once = full.withColumn("copy", best).where("copy = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    pages = F.sort_array(F.array_distinct(F.filter(F.transform("rows", lambda r: r["page"]), lambda p: p.isNotNull())))
    content = F.array_join(F.transform("rows", lambda r: r["content"]), "\n\n")
    once = once.withColumn("passage", place - 1).where(F.col("passage") < most)
    return once.select("query_id", "passage", "course", "doc_path", "lecture", "section", pages.alias("pages"), content.alias("content"), "score")


def retrieve(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embed, rerank, k: int = schema.TOP_K, most: int = schema.MAX_PASSAGES, floor: float = schema.MIN_RERANK_SCORE) -> DataFrame:
    """Passages for queries (query_id, course, question, optional lecture); see passages().

    Equal cosines are ordered by the chunk's id: column id (long) of chunks, or a hash of its key where there is none.
    embed turns a text column into a query vector, rerank (query, content) into a score from 0 to 1.
    """
    asked = queries.select("query_id", "course", "question", *(["lecture"] if "lecture" in queries.columns else [])).withColumn("vector", embed(F.col("question")))
    courses = queries.where("course IS NOT NULL").select("course").distinct()
    named = [r[0] for r in courses.limit(PRUNED + 1).collect()]
    # The chunk table is partitioned by course: with few courses their folders alone are listed and read.
    near_by = chunks.where(F.col("course").isin(named)) if len(named) <= PRUNED else chunks.join(courses, "course", "left_semi")
    paths = documents.select(F.col("id").alias("document_id"), "doc_path", "lecture")
    keyed = near_by.drop("lecture").withColumn("id", F.col("id") if "id" in chunks.columns else F.xxhash64("document_id", "ordinal"))
    rows = keyed.select("id", "document_id", "course", "embedding").join(paths, "document_id")
    if "lecture" in queries.columns:  # a null lecture asks for the whole course
        scope = lambda c, l: F.to_json(F.struct(c.alias("c"), l.alias("l")))
        asked = asked.withColumn("scope", scope(F.col("course"), F.col("lecture")))
        both = F.array_distinct(F.array(scope(F.col("course"), F.lit(None).cast("string")), scope(F.col("course"), F.col("lecture"))))
        pool = rows.select("id", F.explode(both).alias("scope"), F.col("embedding").alias("vector")).join(asked.select("scope").distinct(), "scope", "left_semi")
        near = top_k(asked.drop("course").withColumnRenamed("scope", "course"), pool.withColumnRenamed("scope", "course"), k)
    else:
        near = top_k(asked, rows.select("id", "course", F.col("embedding").alias("vector")), k)
    # The hash of a chunk's key finds its row; course and lecture are compared again, so that no other row can pass.
    # Texts move once, to their hits; what else a hit needs is joined to the few that there are.
    hits = near.join(keyed.drop("embedding"), "id").join(paths, "document_id").join(asked.select("query_id", "question", F.col("course").alias("asked"), *([F.col("lecture").alias("within")] if "lecture" in queries.columns else [])), "query_id")
    hits = hits.where("course = asked" + (" AND (within IS NULL OR lecture = within)" if "lecture" in queries.columns else ""))
    return passages(gated(reranked(hits, rerank(F.col("question"), F.col("content"))), floor), near_by, most)
