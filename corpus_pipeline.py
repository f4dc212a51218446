"""From raw documents to token ids, in stages. Each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, mixing, repetition, setsketch, suffixes
from lectern.llm.common import quoted, remove_path, scratch_path
from lectern.llm.queries import VOCABULARY
from lectern.shipping import ship


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of out in the order of docs."""
    return out.select(*map(quoted, docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    ship(spark)
    rest = [c for c in docs.columns if c != "doc_id"]
    judged = repetition.judge(docs, *rest).where("kept")
    return _as_before(judged.select("doc_id", *(F.col(quoted(f"keep_{c}")).alias(c) for c in rest)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Rows without a doc_id stay."""
    found = setsketch.near_duplicates(docs, hashes=True)
    clash = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__lectern_gone"), F.col("set_hash").alias("__lectern_node")).distinct()
    if not clash:
        return docs.join(gone, docs["doc_id"] == F.col("__lectern_gone"), "left_anti")
    # A doc_id may stand on texts of several groups: each row is judged by its own.
    rows = setsketch.with_set_hash(docs, "__lectern_set")
    left = rows.join(gone, (rows["doc_id"] == F.col("__lectern_gone")) & (rows["__lectern_set"] == F.col("__lectern_node")), "left_anti").drop("__lectern_set")
    named = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(left.where("doc_id IS NULL"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the byte strings that earlier ones have; characters stay whole."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = suffixes.remove_repeats(docs, *rest, texts=True)
    out = out.select("doc_id", F.col("kept_text").alias("text"), *(F.col(quoted(f"keep_{c}")).alias(c) for c in rest))
    return _as_before(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in rest else out, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.repeat(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the bytes decoded from them."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, bpe.digests, bpe.DIGESTS)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix_sources", mix_sources), ("token_ids", token_ids)]

#: Neither edits within documents nor byte-pair merges can be said in SQL; tests/llm/test_pipeline.py has a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # Nothing reads the output of a stage after the next one has written its own.
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
