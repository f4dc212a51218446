"""The queries over the driver's tables: documents are decks, four lines a page, courses are languages, lectures are sources."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schema
from lectern.functions import models, text
from lectern.operators import catalog, evaluate, ground, quiz, retrieval, slides
from lectern.plans import pipelines
from lectern.plans.pipelines import counters, passages_prompt
from lectern.plans.sql import ORACLE
from lectern.sources import files, store
from lectern.sources.shared import cut, numbered

LINES_A_PAGE = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("course"), F.concat("source", F.lit("/"), "doc_id").alias("doc_path"), F.col("source").alias("lecture"))


def page_arrays(spark: SparkSession, sf: str) -> DataFrame:
    numbers = lambda lines: F.sequence(F.lit(0), F.ceil(F.size(lines) / LINES_A_PAGE).cast("int") - 1)
    cut = lambda lines: F.transform(numbers(lines), lambda i: F.array_join(F.slice(lines, i * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)), "\n"))
    # The lines are bound as an element, so that a text is not split again for every page.
    bound = F.transform(F.array(F.split(F.coalesce("text", F.lit("")), "\n")), cut)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("course"), F.get(bound, F.lit(0)).alias("pages"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    # Every document has a page; the outer form spares the test for empty ones, which would cut all texts twice more.
    return page_arrays(spark, sf).select("document_id", "course", F.posexplode_outer("pages").alias("p", "text")).select("document_id", "course", (F.col("p") + 1).alias("page"), "text")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of all documents; a query that reads them more than once starts from stored()."""
    return slides.chunks(pages(spark, sf))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """chunks(), made once and written to the shared folder, as an ingest writes its chunk table."""
    return cut(chunks(spark, sf))


def hits(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    named = rows.drop("lecture").join(documents(spark, sf).select(F.col("id").alias("document_id"), "doc_path", "lecture"), "document_id")
    named = named.withColumn("query_id", F.concat("course", F.lit("/"), F.coalesce("lecture", F.lit("")))).withColumn("score", F.col("token_count") % 101 / F.lit(100.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "ordinal"))
    return named.withColumn("rank", rank).where(F.col("rank") <= schema.TOP_K).select("query_id", "rank", "score", "course", "document_id", "doc_path", "lecture", "section", "ordinal", "content")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf)
    return retrieval.passages(retrieval.gated(hits(spark, sf, rows)), rows)


def cited(spark: SparkSession, sf: str) -> DataFrame:
    return passages(spark, sf).withColumn("citation", text.ask_citation(F.col("doc_path"), F.col("lecture"), F.col("section"), F.col("pages")))


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return quiz.planned(quiz.buckets(chunks(spark, sf), documents(spark, sf)))


def q_bucket_text(spark, sf):
    rows = stored(spark, sf)
    return quiz.bucket_texts(quiz.planned(quiz.buckets(rows, documents(spark, sf))), rows)


def quiz_status(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(spark, sf)
    owned = quiz.allocate(quiz.planned(quiz.buckets(rows, documents(spark, sf))), schema.DEFAULT_QUESTIONS, "course", "lecture")
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("first_ordinal", "key")) - 1
    # Each section has chunks; only the texts of those that are owed questions are compared with quotes.
    chosen = owned.withColumn("section_index", index).join(quiz.bucket_texts(owned.where("quota > 0"), rows), "key", "left").select(F.col("document_id").alias("scope"), "section_index", "key", "quota", "content")
    quote = F.when(F.col("ordinal") % 3 == 0, "entirely made up words").otherwise(F.col("content"))
    asked = rows.select(F.col("document_id").alias("scope"), F.col("ordinal").alias("pos"), F.expr("ordinal div 2").cast("int").alias("section_index"), quote.alias("supporting_quote"))
    told = quiz.judged(asked, chosen).join(chosen.select("scope", "section_index", "key"), ["scope", "section_index"], "left")
    return told, chosen.groupBy("scope").agg(F.count("*").alias("sections_available"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    nan = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    return t.select("doc_id", F.col("lang").alias("course"), F.col("source").alias("kind"), nan("quality").alias("faithfulness"), F.col("toxic").cast("double").alias("answer_relevancy"), (F.col("n_chars") % 1000 / 1000.0).alias("context_precision"))


THREE = ("faithfulness", "answer_relevancy", "context_precision")


def q_vector_topk(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("course"), F.col("embedding").alias("vector"))
    found = retrieval.top_k(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def q_scoped_search(spark, sf):
    """Every vector whose id is divisible by 100 asks within its own course and lecture, or within the whole course where it names none."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("course"), (F.col("vec_id") % 3).cast("string").alias("lecture"), F.col("embedding").alias("vector"))
    asked = e.where("id % 100 = 0").withColumn("lecture", F.when(F.col("id") % 200 == 0, F.col("lecture")))
    scope = lambda c, l: F.to_json(F.struct(c.alias("c"), l.alias("l")))
    both = F.explode(F.array(scope(F.col("course"), F.lit(None).cast("string")), scope(F.col("course"), F.col("lecture"))))
    found = retrieval.top_k(asked.select(F.col("id").alias("query_id"), scope(F.col("course"), F.col("lecture")).alias("course"), "vector"), e.select("id", both.alias("course"), "vector"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def q_topk_edge_vectors(spark, sf):
    """vector_topk where some vectors are null, zero or hold a null component: these find nothing and are not found."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("course"), F.col("embedding").alias("v"))
    part = F.when(F.col("vec_id") % 7 == 1, F.lit(None)).when(F.col("vec_id") % 7 == 2, F.transform("v", lambda x: x * 0)).when(F.col("vec_id") % 7 == 3, F.transform("v", lambda x, i: F.when(i > 0, x))).otherwise(F.col("v"))
    e = e.withColumn("vector", part).drop("v")
    found = retrieval.top_k(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


#: The letters that q_retrieve's encoder counts.
LETTERS = "etaoinshrdlcumwfgypbvk"


def letter_counts(c):
    """A deterministic encoder that SQL can state too: how often each of LETTERS stands in the lower-cased text."""
    code = np.full(256, len(LETTERS), np.uint8)
    for i, x in enumerate(LETTERS):
        code[[ord(x), ord(x.upper())]] = i

    def count(texts: pa.Array) -> pa.Array:
        # Bytes below 128 are characters of their own; the two others whose lower case holds one of LETTERS are written out.
        for other, x in (("\u212a", "k"), ("\u0130", "i")):
            texts = pa.compute.replace_substring(texts, other, x)
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        codes = code[np.frombuffer(data or b"", np.uint8)]
        out = np.empty((len(texts), len(LETTERS)), np.float32)
        for i in range(len(texts)):
            out[i] = np.bincount(codes[at[i] : at[i + 1]], minlength=len(LETTERS) + 1)[:-1]
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(LETTERS), dtype=np.int32), out.ravel())

    return F.arrow_udf(count, T.ArrayType(T.FloatType()))(F.coalesce(c, F.lit("")))


def _questions(spark, sf):
    """Every document whose id is divisible by 100 asks with the start of its text, within its course, and every second of these within its lecture."""
    t = table(spark, sf, "documents").where("doc_id % 100 = 0")
    return t.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("course"), F.when(F.col("doc_id") % 200 == 0, F.col("source")).alias("lecture"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("question"))


def q_retrieve(spark, sf):
    """The whole retrieval: scoped search, reranking, gate, expansion, passages."""
    held = stored(spark, sf).withColumn("embedding", letter_counts(F.col("content"))).withColumn("id", F.col("document_id") * 1000000 + F.col("ordinal"))
    found = retrieval.retrieve(_questions(spark, sf), held, documents(spark, sf), letter_counts, models.overlap_score)
    return found.select("query_id", "passage", "doc_path", "section", F.array_join("pages", ",").alias("pages"), F.md5("content").alias("content"), F.round("score", 6).alias("score"))


def q_ask_status(spark, sf):
    """Answers whose generator fails for every third question, which must show as an error and not as an empty answer."""

    def make():
        good = models.extractive_answers()

        def answer(system, user, temperature):
            if int(re.search(r"Question: (-?\d+)", user).group(1)) % 3 == 0:
                return '{"claims": [{"text": "no index"}]}'
            return good(system, user, temperature)

        return answer

    held = stored(spark, sf).withColumn("embedding", letter_counts(F.col("content"))).withColumn("id", F.col("document_id") * 1000000 + F.col("ordinal"))
    asked = _questions(spark, sf).withColumn("question", F.concat(F.expr("query_id div 100").cast("string"), F.lit(" "), "question"))
    out = pipelines.ask(asked, held, documents(spark, sf), letter_counts, generator=make)
    return out.select("query_id", F.col("error").isNotNull().alias("failed"), (F.col("not_covered") == schema.NO_CONTEXT).alias("no_context"))


def q_quiz_prompts(spark, sf):
    """The prompt of the first round of every lecture's quiz."""
    rows = stored(spark, sf)
    owned = quiz.allocate(quiz.planned(quiz.buckets(rows, documents(spark, sf))), schema.DEFAULT_QUESTIONS, "course", "lecture").where("quota > 0")
    index = F.row_number().over(Window.partitionBy("course", "lecture").orderBy("doc_path", "first_ordinal", "key")) - 1
    owned = owned.withColumn("section_index", index).join(quiz.bucket_texts(owned, rows), "key")
    chosen = owned.select(F.concat_ws(" / ", "course", "lecture").alias("scope"), "section_index", "label", "quota", "content")
    return pipelines.sections_prompt(chosen).select("scope", F.md5("prompt").alias("prompt"))


def q_quiz_means(spark, sf):
    """Mean faithfulness by scope (course / lecture) with unscored questions left out, and how many questions have the text of their section."""
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    asked = t.select(F.concat_ws(" / ", "lang", "source").alias("scope"), F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("0")).alias("section_key"), F.coalesce(F.col("quality").cast("double"), F.lit(float("nan"))).alias("faithfulness"))
    texts = q_bucket_text(spark, sf)
    found = evaluate.with_section_texts(asked, texts)
    held = found.groupBy("scope").agg(F.count_if(F.col("context") != "").alias("with_text"))
    return evaluate.means_by(found, "scope", "faithfulness").join(held, "scope")


def q_footer_detect(spark, sf):
    return slides.footers(pages(spark, sf))


def q_parse_slides(spark, sf):
    p = pages(spark, sf)
    return slides.parse(p, slides.footers(p)).select("document_id", F.col("page").cast("long").alias("page"), "title", "body")


def q_sections_ffill(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.when(F.col("role") == "user", "Outline").otherwise(F.col("role")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    return slides.with_sections(turns)


def q_lecture_detect(spark, sf):
    t, body = table(spark, sf, "conversations"), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("Lecture "), F.col("turn").cast("string"), F.lit("0 : "), body)
    return t.select("conv_id", "turn", text.lecture_id(head).alias("lecture"), text.lecture_id(body).alias("none"))


def _files(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("course"), F.concat("source", F.lit("/"), "doc_id").alias("doc_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "n_chars", "doc_id", "text")


def q_new_files(spark, sf):
    f = _files(spark, sf)
    known = f.where("n_chars > 2000").groupBy("course", "content_hash").agg(F.min("doc_path").alias("doc_path"))
    return store.new_files(f, known)[0].select("course", "doc_path", "content_hash")


def q_upsert_documents(spark, sf):
    f = _files(spark, sf).drop("text")
    cols = ("id", "course", "doc_path", "content_hash", F.col("i").alias("ingested_at"), F.col("i").alias("updated_at"))
    old = f.where("n_chars >= 1000").withColumn("id", F.col("doc_id")).withColumn("i", F.lit(1)).select(*cols)
    fresh = _files(spark, sf).where("n_chars < 3000").withColumn("id", F.col("doc_id") + 1000000).withColumn("content_hash", F.sha2(F.concat(F.lit("new"), F.coalesce("text", F.lit(""))), 256)).withColumn("i", F.lit(2)).select(*cols)
    return store.upsert_documents(old, fresh).withColumnsRenamed({"ingested_at": "ingested", "updated_at": "updated"})


def q_replace_chunks(spark, sf):
    old = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("ordinal"), F.col("text").alias("content"), F.lit(1).alias("created_at"))
    fresh = old.where("ordinal < 2").withColumn("content", F.concat(F.lit("new "), "content"))
    return store.replace_chunks(old, fresh, fresh).drop("created_at")


def q_score_gate(spark, sf):
    return retrieval.gated(hits(spark, sf, chunks(spark, sf))).select("query_id", "document_id", "ordinal", "score")


def q_rerank_order(spark, sf):
    return retrieval.reranked(hits(spark, sf, chunks(spark, sf)), F.round("score", 1)).select("query_id", "document_id", "ordinal", F.col("rank").alias("new_rank"))


def q_expand_spans(spark, sf):
    rows = stored(spark, sf)
    return retrieval.spans(hits(spark, sf, rows), rows).select("query_id", "rank", "ordinal", "page")


def q_passages(spark, sf):
    return passages(spark, sf).select("query_id", "passage", "doc_path", "section", F.array_join("pages", ",").alias("pages"), F.md5("content").alias("content"), "score")


def q_ask_prompts(spark, sf):
    return passages_prompt(cited(spark, sf).withColumn("question", F.col("query_id"))).select("query_id", F.md5("prompt").alias("prompt"))


def _quotes(spark, sf):
    b = numbered(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")), "i", F.col("item_id"))
    n = b.count()
    return table(spark, sf, "documents").withColumn("i", F.col("doc_id") % n), b.withColumn("i", F.col("i").cast("long") - 1)


def q_quote_support(spark, sf):
    d, b = _quotes(spark, sf)
    return d.join(b, "i").select("doc_id", "item_id", text.quote_supported(F.col("quote"), F.coalesce("text", F.lit(""))).alias("supported"))


def q_rerank_overlap(spark, sf):
    d, b = _quotes(spark, sf)
    return d.join(b, "i").select("doc_id", "item_id", F.round(models.overlap_score(F.col("quote"), F.coalesce("text", F.lit(""))), 6).alias("score"))


def q_verify_claims(spark, sf):
    t = table(spark, sf, "conversations")
    said = t.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("passage"), F.col("text").alias("content"), F.lit("").alias("citation"))
    claims = t.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("claim"), "text", (F.col("turn") - 1).alias("passage_index"), F.col("text").alias("supporting_quote"))
    return ground.verdicts(claims, said).select(F.col("query_id").alias("conv_id"), F.col("claim").alias("turn"), "status")


def q_quiz_report(spark, sf):
    told, available = quiz_status(spark, sf)
    return quiz.shortfall(quiz.report(told, available), F.lit(10)).select("scope", "n_generated", "n_kept", "n_dropped_over_quota", "sections_covered", "sections_available", "coverage", "quote_validity", "short")


def q_routes(spark, sf):
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    g = t.select(F.col("lang").alias("course"), F.when(F.col("quality") == 0, schema.NOT_IN_CORPUS).otherwise("x").alias("reference"), F.when(F.col("toxic") == 1, "unanswerable").alias("kind"))
    return evaluate.routed(g).groupBy("course", "route").agg(F.count("*").alias("n"))


def q_abstention(spark, sf):
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    t = t.select(F.col("lang").alias("course"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("abstained"), (F.col("n_chars") % 3).alias("n_claims"), F.col("quality").cast("double").alias("faithfulness"))
    return evaluate.abstention(t, "course")


def q_worst_first(spark, sf):
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return evaluate.worst_first(t, "quality", "doc_id").withColumn("place", F.col("place").cast("int"))


def q_catalog_rollup(spark, sf):
    t = catalog.courses(catalog.listing(documents(spark, sf), chunks(spark, sf)))
    shown = F.transform("documents", lambda d: F.concat(d["doc_path"], F.lit("="), d["chunks"].cast("string")))
    return t.select("course", "chunks", F.md5(F.array_join(shown, ";")).alias("documents"))


def q_oversized_split(spark, sf):
    lines = F.split("text", "\n")
    t = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.get(lines, F.lit(0)).alias("title"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n").alias("body"))
    return t.select("doc_id", F.posexplode(slides.packed_lines(F.col("title"), F.col("body"))).alias("p", "c")).select("doc_id", (F.col("p") + 1).alias("part"), F.md5("c").alias("content"))


def _paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("rel_path"), F.col("html").cast("binary").alias("content"), F.lit("md").alias("suffix"))


def q_file_identity(spark, sf):
    return files.identified(_paths(spark, sf))[0].select("page_id", "course", "doc_path", "content_hash")


def q_corpus_layout(spark, sf):
    p = _paths(spark, sf).withColumnRenamed("rel_path", "path")
    counts = p.groupBy(F.get(F.split("path", "/"), F.lit(0)).alias("course")).agg(F.count("*").alias("files"))
    return catalog.layout(p)[0].join(counts, "course")


def q_ingest_counters(spark, sf):
    n = chunks(spark, sf).groupBy("document_id").agg(F.count("*").alias("n"))
    t = documents(spark, sf).join(n, F.col("id") == F.col("document_id"), "left").select(F.col("doc_path").alias("rel_path"), F.when(F.col("n") > 0, "ingested").otherwise("skipped").alias("status"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" chunks")).alias("detail"))
    return counters(t)


def q_profile_text(spark, sf):
    return page_arrays(spark, sf).select("document_id", F.md5(F.nullif(files.profile_text(F.col("pages")), F.lit(""))).alias("joined"))


QUERIES = {
    "vector_topk": q_vector_topk,
    "scoped_search": q_scoped_search,
    "topk_edge_vectors": q_topk_edge_vectors,
    "retrieve": q_retrieve,
    "ask_status": q_ask_status,
    "quiz_means": q_quiz_means,
    "quiz_prompts": q_quiz_prompts,
    "clean_text": lambda s, d: table(s, d, "pages").select("page_id", F.md5(text.clean(F.col("html"))).alias("cleaned")),
    "doc_type": lambda s, d: table(s, d, "pages").select("page_id", text.doc_type(F.col("url")).alias("doc_type")),
    "footer_detect": q_footer_detect,
    "parse_slides": q_parse_slides,
    "sections_ffill": q_sections_ffill,
    "chunk_ordinals": lambda s, d: chunks(s, d).select("document_id", "course", "section", "ordinal", "page", F.md5("content").alias("content"), "token_count"),
    "breadcrumbs": lambda s, d: chunks(s, d).drop("lecture").join(documents(s, d).select(F.col("id").alias("document_id"), "lecture"), "document_id").select("document_id", "ordinal", F.md5(text.breadcrumb(F.col("course"), F.col("lecture"), F.col("section"), F.col("content"))).alias("crumb")),
    "lecture_detect": q_lecture_detect,
    "hash_dedupe": lambda s, d: _files(s, d).groupBy("course", "content_hash").agg(F.count("*").alias("copies"), F.min("doc_path").alias("first_path")),
    "new_files": q_new_files,
    "upsert_documents": q_upsert_documents,
    "replace_chunks": q_replace_chunks,
    "score_gate": q_score_gate,
    "rerank_order": q_rerank_order,
    "expand_spans": q_expand_spans,
    "passages": q_passages,
    "ask_citations": lambda s, d: cited(s, d).select("query_id", "passage", "citation"),
    "ask_prompts": q_ask_prompts,
    "quote_support": q_quote_support,
    "rerank_overlap": q_rerank_overlap,
    "meta_claims": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.is_meta_claim(F.col("text")).alias("meta")),
    "verify_claims": q_verify_claims,
    "buckets": lambda s, d: quiz.buckets(chunks(s, d), documents(s, d)).select("document_id", "label", "first_ordinal", "last_ordinal", "n_chunks"),
    "plan_buckets": lambda s, d: plan(s, d).select("key", "label", "first_ordinal", "last_ordinal", "n_chunks"),
    "allocate": lambda s, d: quiz.allocate(plan(s, d), schema.DEFAULT_QUESTIONS, "course", "lecture").select("key", "course", "lecture", "quota"),
    "bucket_text": lambda s, d: q_bucket_text(s, d).select("key", F.md5("content").alias("content")),
    "quiz_citations": lambda s, d: plan(s, d).select("key", text.quiz_citation(F.col("doc_path"), F.col("lecture"), F.col("label")).alias("citation")),
    "quota_filter": lambda s, d: quiz_status(s, d)[0].select("scope", "pos", "status"),
    "quiz_report": q_quiz_report,
    "eval_by_kind": lambda s, d: evaluate.means_by(scores(s, d), "kind", *THREE),
    "below_threshold": lambda s, d: evaluate.below(evaluate.means_by(scores(s, d), "course", *THREE), "course", *THREE),
    "marks": lambda s, d: evaluate.marks(evaluate.means_by(scores(s, d), "course", *THREE), "course", *THREE),
    "routes": q_routes,
    "abstention": q_abstention,
    "worst_first": q_worst_first,
    "catalog": lambda s, d: catalog.listing(documents(s, d), chunks(s, d)),
    "catalog_rollup": q_catalog_rollup,
    "scopes": lambda s, d: catalog.scopes(documents(s, d)),
    "course_lectures": lambda s, d: catalog.lectures(documents(s, d)),
    "line_profile": lambda s, d: catalog.profile(table(s, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text"),
    "line_samples": lambda s, d: catalog.samples(table(s, d, "documents"), "doc_id", "text"),
    "oversized_split": q_oversized_split,
    "file_identity": q_file_identity,
    "corpus_layout": q_corpus_layout,
    "ingest_counters": q_ingest_counters,
    "html_preview": lambda s, d: table(s, d, "pages").select("page_id", text.escape_html(F.substring("html", 1, 700)).alias("preview")),
    "profile_text": q_profile_text,
}
