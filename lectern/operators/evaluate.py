"""Scores to means, rates and verdicts. NaN and null are unscored, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import schema
from lectern.sources.shared import numbered


def scored(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def mean(c: str) -> Column:
    """Mean of what was scored, to 4 digits; null if nothing was."""
    return F.round(F.avg(scored(c)), 4)


def means_by(rows: DataFrame, by: str, *metrics: str) -> DataFrame:
    """by, n and, of each metric, the mean (name), scored and unscored counts."""
    aggs = [F.count("*").alias("n")]
    for m in metrics:
        aggs += [mean(m).alias(m), F.count(scored(m)).alias(f"{m}_scored"), (F.count("*") - F.count(scored(m))).alias(f"{m}_unscored")]
    return rows.groupBy(by).agg(*aggs)


def below(means: DataFrame, by: str, *metrics: str, threshold: float = schema.PASS_MARK) -> DataFrame:
    """by, below_threshold: names of the metrics under the threshold, in the order given, joined by commas; metrics without a mean are not."""
    names = F.filter(F.array(*(F.when(F.col(m) < threshold, F.lit(m)) for m in metrics)), lambda x: x.isNotNull())
    return means.select(by, F.array_join(names, ",").alias("below_threshold"))


def marks(means: DataFrame, by: str, *metrics: str, threshold: float = schema.PASS_MARK) -> DataFrame:
    """by, metric, value, mark, one row a metric."""
    stack = ", ".join(f"'{m}', `{m}`" for m in metrics)
    t = means.select(by, F.expr(f"stack({len(metrics)}, {stack}) AS (metric, value)"))
    return t.withColumn("mark", F.when(F.col("value").isNull(), "NOT SCORED").when(F.col("value") >= threshold, "PASS").otherwise("FAIL"))


def routed(gold: DataFrame) -> DataFrame:
    """gold with route: abstention where no answer exists, by reference or kind; else judged."""
    none = (F.col("reference") == schema.NOT_IN_CORPUS) | F.coalesce(F.col("kind") == "unanswerable", F.lit(False))
    return gold.withColumn("route", F.when(F.coalesce(none, F.lit(False)), "abstention").otherwise("judged")).withColumn("kind", F.coalesce("kind", F.lit("conceptual")))


def abstention(rows: DataFrame, by: str) -> DataFrame:
    """by, n_abstention, abstention_rate, abstention_faithfulness. rows: abstained, n_claims, faithfulness; no claims are faithful."""
    faith = F.when(F.col("n_claims") == 0, 1.0).otherwise(scored("faithfulness"))
    return rows.groupBy(by).agg(F.count("*").alias("n_abstention"), F.round(F.avg(F.col("abstained").cast("int")), 4).alias("abstention_rate"), F.round(F.avg(faith), 4).alias("abstention_faithfulness"))


def worst_first(rows: DataFrame, metric: str, *ties: str) -> DataFrame:
    """Unscored rows, then from the lowest score up, with their place in that order."""
    return numbered(rows.withColumn(metric, scored(metric)), "place", F.asc_nulls_first(metric), *map(F.col, ties)).orderBy("place")


def with_section_texts(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """questions with context, the text of their section (section_key); empty where there is none. texts: key, content."""
    found = texts.select(F.col("key").alias("section_key"), F.col("content").alias("context"))
    return questions.join(found, "section_key", "left").withColumn("context", F.coalesce("context", F.lit("")))


def require_samples(rows: DataFrame) -> DataFrame:
    """rows, unless there are none, which has nothing to be scored."""
    if rows.isEmpty():
        raise ValueError("nothing to score")
    return rows


def failed(means: DataFrame, *metrics: str, threshold: float = schema.PASS_MARK) -> bool:
    """Whether any mean is under the threshold: the exit code of an evaluation."""
    under = F.lit(False)
    for m in metrics:
        under = under | F.coalesce(F.col(m) < threshold, F.lit(False))
    return not means.where(under).isEmpty()
