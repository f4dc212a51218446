"""The queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from .common import scratch_path
from . import bpe, importance, lattice, licenses, mixing, packing, repetition, setsketch, suffixes, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: size, source_size, target, and the words that the mix takes of each."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors: their links at cosine 0.98 within a label, component and verdict."""
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: bytes removed because earlier documents have them, and a hash of the rest."""
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, laid out in folders by with_paths(): own and inherited licenses."""
    return licenses.scan(licenses.with_paths(_table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts and the verdict of the repetition rules."""
    judged = repetition.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: near-duplicates on 2-word shingles at 80 percent."""
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: ids of the byte-level vocabulary and the bytes decoded from them, as hashes."""
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, bpe.digests, bpe.DIGESTS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: score and verdict of a network trained on the labelled ones that are not held out."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed, the matrices written, and what was written read back and digested."""
    path = scratch_path(spark, "packs")
    packing.write(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN), path)
    return packing.digests(spark.read.parquet(path))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: log weight, key and whether drawn."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {"op3_license_scan": op3_license_scan, "op5_toxicity": op5_toxicity, "op6_pack_tokens": op6_pack_tokens, "op10_importance_resampling": op10_importance_resampling, "op1_lattice_near_dedup": op1_lattice_near_dedup, "op2_suffix_array_dedup": op2_suffix_array_dedup, "op4_quality_rules": op4_quality_rules, "op7_minhash_near_dedup": op7_minhash_near_dedup, "op8_byte_bpe": op8_byte_bpe, "op9_mix_sources": op9_mix_sources}
OP7_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w[1] AS g FROM t WHERE len(w) = 1
  UNION ALL SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.size + y.size - common)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
ORACLE = {"op3_license_scan": licenses.ORACLE, "op1_lattice_near_dedup": lattice.ORACLE, "op2_suffix_array_dedup": suffixes.ORACLE, "op4_quality_rules": repetition.ORACLE, "op7_minhash_near_dedup": OP7_SQL, "op9_mix_sources": mixing.ORACLE}
