"""Tables and limits of the library."""

from __future__ import annotations

from pyspark.sql import types as T

DOC_TYPES = ("slides", "notes", "tutorial_q", "tutorial_soln")

#: Documents by identity (course, doc_path); id is a hash of both.
DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("course", T.StringType(), False),
        T.StructField("doc_path", T.StringType(), False),
        T.StructField("content_hash", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("lecture", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
#: Chunks by identity (document_id, ordinal); the vector's length is checked on write.
CHUNKS = T.StructType(
    [
        T.StructField("document_id", T.LongType(), False),
        T.StructField("course", T.StringType(), False),
        T.StructField("section", T.StringType()),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("page", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embed_model", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
GOLD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "course", "question", "reference", "section", "kind")])
ANSWER = "claims array<struct<text string NOT NULL, passage_index int NOT NULL, supporting_quote string NOT NULL>> NOT NULL, analogy string, exam_angle string, common_trap string, check_yourself array<string>, not_covered string"
QUIZ = "questions array<struct<question string NOT NULL, answer string NOT NULL, supporting_quote string NOT NULL, section_index int NOT NULL>> NOT NULL"

# Fixed values of the retrieval and quiz rules.
EMBED_DIM, TOP_K, MAX_PASSAGES, WINDOW_RADIUS = 768, 20, 4, 1
MIN_RERANK_SCORE, RELATIVE_FLOOR = 0.02, 0.03
QUOTE_OVERLAP = 0.75
FOOTER_MIN_SHARE, MIN_TOKENS, MAX_TOKENS = 0.6, 15, 450
RUN_CHUNKS, MAX_QUESTIONS, DEFAULT_QUESTIONS, TOPUP_ROUNDS = 8, 25, 10, 1
PASS_MARK = 0.80
NOT_IN_CORPUS = "NOT_IN_CORPUS"
SECTION_MARKERS = ("outline", "agenda", "contents", "overview", "roadmap")
NO_CONTEXT = "No passage of this course is close enough to the question to base an answer on. Other words may help, or the lecture in question may not have been added yet."
#: Pages of decks that grow page by page.
PAGES = T.StructType([T.StructField("document_id", T.LongType(), False), T.StructField("course", T.StringType(), False), T.StructField("page", T.IntegerType(), False), T.StructField("text", T.StringType())])
