"""Data selection by importance resampling (Xie et al. 2023).

Texts are bags of hashed word unigrams and bigrams. Two generative models, multinomials over
the hash buckets, are fitted: one to target texts, one to all texts. A document's
log weight is the sum of log(target / raw) over its n-grams. Adding Gumbel noise, fixed by the
doc_id, and keeping the k largest draws k documents without replacement in proportion to
their weights.

The raw model counts every n-gram of every document. The target model is fitted on at most
TARGET_ROWS labelled rows, those of lowest hash. k is the share of good ones among all labelled rows, of all documents.

Cases: null and empty texts have log weight 0; very long texts count with all their n-grams; a null doc_id draws the noise of 0; rows equal in
doc_id share their noise; equal keys fall back to doc_id; without labels the weights are 0 and
all documents are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, flat, mix, ngrams, slices, span_hashes, text_columns, words_of

BUCKETS, TARGET_ROWS = 10_000, 20_000
#: Rows of one bin that may be ranked together when the k-th largest key is looked for.
RANKED = 10_000


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and row of every word and word pair."""
    buf = LOWER[buf]
    start, end, counts = words_of(buf, off)
    words = span_hashes(buf, start, end)
    one, two = ngrams(words, counts, 1), ngrams(words, counts, 2)
    return (mix(np.concatenate((one[0], two[0])) + np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((one[1], two[1]))


def target_ids(labels: DataFrame, most: int) -> list[int]:
    """The doc_ids that the target model is fitted on."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return sorted(r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect())


def log_ratios(docs: DataFrame, targets: list[int]) -> np.ndarray:
    """log(target / raw) of every bucket, by counts over all documents, with one added to each."""
    wanted = np.array(targets, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in slices(batches, "text"):
            bucket, row = features(*flat(b["text"]))
            is_target = np.isin(b["doc_id"].fill_null(-1).to_numpy(), wanted) & b["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[is_target[row]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": some, "raw": total[0, some], "target": total[1, some]})

    found = text_columns(docs).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.ones((2, BUCKETS))
    for bucket, raw, target in found:  # BUCKETS rows at most
        counts[:, bucket] += raw, target
    if counts[1].sum() == BUCKETS:
        return np.zeros(BUCKETS)
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight, key (log weight plus Gumbel noise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            bucket, row = features(*flat(b["text"]))
            weight = np.bincount(row, ratios[bucket], b.num_rows)
            bits = mix(mix(b["doc_id"].fill_null(0).to_numpy().view(np.uint64) + np.uint64(0x5EED)))
            u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(weight), pa.array(weight - np.log(-np.log(u)))], names=["doc_id", "log_weight", "key"])

    return text_columns(docs).mapInArrow(run, "doc_id long, log_weight double, key double")


def largest(scored: DataFrame, k: int, ranked: int = RANKED) -> DataFrame:
    """scored with a column kept, true for the k rows of largest key (then smallest doc_id).

    Counts by equal bins of the key close in on the k-th largest, bin within bin, until
    the bin that holds it has few rows; only these are ranked.
    """
    lo, hi, n = scored.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n or k <= 0:
        return scored.withColumn("kept", F.lit(k > 0))
    above, bins = 0, 1024
    while True:
        inside = scored.where((F.col("key") >= lo) & (F.col("key") <= hi))
        width = (hi - lo) / bins
        if n <= ranked or width <= 0 or lo + width == lo:
            break
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for r in counts:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (lo, hi) == (r["lo"], r["hi"]):
            break
        lo, hi, n = r["lo"], r["hi"], r["n"]
    here = (F.col("key") >= lo) & (F.col("key") <= hi)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("key"), F.asc_nulls_last("doc_id")))
    settled = scored.where(~here).withColumn("kept", F.col("key") > hi)
    return settled.unionByName(inside.withColumn("kept", rank <= k - above))


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, log_weight, key, kept for every row of docs. keep: the share to draw; by default that of good rows in labels."""
    ratios = log_ratios(docs, target_ids(labels, target_rows))
    rows = docs.count()
    scored = cut(score(docs, ratios), rows, 5_000)
    if keep is None:
        good, judged = labels.where("quality IS NOT NULL").agg(F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)), F.count("*")).first()
        keep = good / judged if judged else 1.0
    return largest(scored, round(keep * rows))
