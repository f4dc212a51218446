"""Checks of generated claims against the passages that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text


def verdicts(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """claims with status: no such passage, about the passages, quote not found, or kept; in that order of tests.

    claims: query_id, claim, text, passage_index, supporting_quote; passages: query_id, passage, content and, for
    citations, citation.
    """
    cited = passages.select("query_id", F.col("passage").alias("passage_index"), F.col("content").alias("source"), "citation")
    joined = claims.join(cited, ["query_id", "passage_index"], "left")
    status = (
        F.when(F.col("source").isNull(), "bad_index")
        .when(text.is_meta_claim(F.col("text")), "meta")
        .when(~F.coalesce(text.quote_supported(F.col("supporting_quote"), F.col("source")), F.lit(False)), "unverified")
        .otherwise("kept")
    )
    return joined.withColumn("status", status)


def answers(queries: DataFrame, passages: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id, claims (text, citation), explanation, citations, n_claims, not_covered for every query; those without passages say so."""
    claim = F.struct("claim", "text", "citation")
    kept = judged.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("status") == "kept", claim))).alias("c"), F.max("not_covered").alias("said") if "not_covered" in judged.columns else F.lit(None).cast("string").alias("said"))
    some = passages.select("query_id").distinct().withColumn("found", F.lit(True))
    out = queries.select("query_id").join(some, "query_id", "left").join(kept, "query_id", "left")
    c = F.coalesce("c", F.array().cast(kept.schema["c"].dataType))
    text_of, cite_of = F.transform(c, lambda x: x["text"]), F.transform(c, lambda x: x["citation"])
    return out.select(
        "query_id", F.transform(c, lambda x: F.struct(x["text"].alias("text"), x["citation"].alias("citation"))).alias("claims"),
        F.array_join(text_of, " ").alias("explanation"), F.array_join(cite_of, " ").alias("citations"), F.size(c).cast("long").alias("n_claims"),
        F.when(F.col("found").isNull(), schema.NO_CONTEXT).otherwise(F.coalesce("said", F.lit(""))).alias("not_covered"),
    )
