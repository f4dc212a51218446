"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is a share of all words (water-filling under a cap on repeats). Each document first gets its certain
whole copies, floor(target / source size). The words still missing come from a sample without replacement with
inclusion probabilities in proportion to size: min(1, rate * size), the rate being such that the expected words of the
sample are those missing. Documents of probability 1 are taken. The others are ranked by their random odds over
their inclusion odds (Pareto order sampling, Rosen 1997), and the sample is the prefix of that ranking whose
words come closest to what is missing: its size in words is fixed, not left to chance. Documents of more than twice the missing words
would miss the target by more than nothing does, and are not drawn.

Cases: null text has size 0; a null source is a source of its own, last in order; equal ranks fall back to doc_id and
size, and rows equal in both are interchangeable; documents without words take nothing beyond their
whole copies, which have no words; very long texts are only counted; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import numbered

from .common import MEMBERS, WORD, cut, join_hot

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Rank bins of a source. Only sums of bins meet in one place; a bin's own rows are ranked apart.
BINS = 4096
#: Sources up to which their targets are broadcast; more are joined.
FEW = 100_000


def _name(source: str) -> F.Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def _size() -> F.Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, documents, target: one row a source, of any number of sources.

    The water level rises from total / weights: sources whose cap lies under it stop there, and what they leave
    raises it for the others, until no further one stops. Only sums reach the driver.
    """
    s = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), "rank", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    s = cut(s.withColumn("weight", weight.cast("double")).withColumn("cap", MAX_REPEATS * F.col("source_size")))
    total, weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (float(total) / weights if weights else 0.0), None
    while True:
        under = s.where(F.col("cap") < F.lit(level) * F.col("weight")).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if tuple(under) == stopped or not weights or under[1] >= weights:
            break
        stopped = tuple(under)
        level = float(total - under[0]) / (weights - under[1])
    return s.select("source", "source_size", "documents", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def goals(sized: DataFrame) -> DataFrame:
    """targets() with whole (copies of every document), missing (words), rate, and rest: the missing words less those of the certain documents."""
    goal = targets(sized).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = cut(goal.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("key", _name("source")))
    # A source has few distinct sizes: what is certain is settled on them, from the longest down.
    classes = sized.where("size > 0").groupBy(_name("source").alias("key"), "size").agg(F.count("*").alias("n"))
    classes = classes.join(goal.select("key", "missing"), "key").where(F.col("size") <= 2 * F.col("missing"))
    longer = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words, squares = (F.col("n") * F.col("size")).cast("decimal(38,0)"), F.col("n").cast("decimal(12,0)") * F.col("size").cast("decimal(12,0)") * F.col("size").cast("decimal(12,0)")
    left = F.col("missing") - F.coalesce(F.sum(words).over(longer), F.lit(0)).cast("double")
    classes = classes.withColumn("left", left).withColumn("rate", F.col("left") / F.sum(squares).over(up_to).cast("double"))
    rate = classes.groupBy("key").agg(F.max(F.when(F.col("rate") * F.col("size") <= 1, F.struct("size", "rate", "left"))).alias("b"), F.sum(words).cast("double").alias("able"))
    # Where all that can be drawn is less than what is missing, all of it is certain.
    rate = rate.select("key", F.coalesce("b.rate", F.lit(1e300)).alias("rate"), F.coalesce("b.left", F.lit(0.0)).alias("rest"))
    return cut(goal.join(rate, "key", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0))).withColumn("rest", F.coalesce("rest", F.lit(0.0))))


def _drawn(rows: DataFrame, sized: DataFrame, goal: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, source, size and more) with source_size, target, copies, taken. sized: the same documents, slim; n: their number."""
    few = goal.limit(FEW + 1).count() <= FEW
    told = goal.select("key", "source_size", "target", "whole", "missing", "rate", "rest", F.col("documents").alias(MEMBERS))

    def ranked(t: DataFrame) -> DataFrame:
        t = t.withColumn("key", _name("source"))
        t = t.join(F.broadcast(told.drop(MEMBERS)), "key") if few else join_hot(t, told, ["key"], n)
        able = (F.col("size") > 0) & (F.col("size") <= 2 * F.col("missing"))
        odds = F.col("rate") * F.col("size")
        u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
        t = t.withColumn("certain", able & (odds >= 1)).withColumn("pareto", F.when(able & (odds < 1) & (odds > 0), u / (1 - u) / (odds / (1 - odds))))
        # What is not ranked is dealt out by its doc_id, so that it gathers nowhere.
        aside = -1 - F.pmod(F.xxhash64("doc_id"), F.lit(BINS)).cast("int")
        return t.withColumn("bin", F.coalesce(F.floor(F.col("pareto") / (1 + F.col("pareto")) * BINS).cast("int"), aside))

    bins = ranked(sized).groupBy("key", "bin").agg(F.sum("size").alias("bin_size"))
    lower = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("bin") >= 0, F.col("bin_size"))).over(lower), F.lit(0))
    bins = bins.select("key", "bin", before.alias("before"))
    inside = Window.partitionBy("key", "bin").orderBy("pareto", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = ranked(rows).join(bins, ["key", "bin"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    drawn = F.col("certain") | (F.col("pareto").isNotNull() & (2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")))
    copies = F.least(F.col("whole") + F.when(drawn, 1).otherwise(0), F.lit(MAX_REPEATS)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * copies).select(*rows.columns, "source_size", "target", "copies", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    n = docs.count()
    sized = cut(sizes(docs), n, 5_000)
    return _drawn(sized, sized, goals(sized), n)


def repeat(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    n = docs.count()
    sized = cut(sizes(docs), n, 5_000)
    # A row travels whole, so that no row needs to be found again; columns of any name and type do no harm.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), F.struct("*").alias("row"))
    out = _drawn(rows, sized, goals(sized), n).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("time")).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), s1 AS (
  SELECT *, (rank % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap FROM s0
), s2 AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS pos,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s1
), s3 AS (
  SELECT *, min(CASE WHEN level * weight <= cap THEN pos END) OVER () AS first FROM s2
), s4 AS (
  SELECT *, max(CASE WHEN pos = first THEN level END) OVER () AS water FROM s3
), goal AS (
  SELECT source, source_size, CASE WHEN pos < first THEN cap::DOUBLE ELSE least(cap::DOUBLE, water * weight) END AS target FROM s4
), g AS (
  SELECT *, target - whole * source_size AS missing FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goal)
), classes AS (
  SELECT g.source, missing, size, count(*) AS n FROM sized JOIN g ON sized.source IS NOT DISTINCT FROM g.source WHERE size > 0 AND size <= 2 * missing GROUP BY ALL
), sums AS (
  SELECT source, size, missing - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
    (sum(n * size * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS squares FROM classes
), rates AS (
  SELECT source, coalesce(arg_max(rest / squares, size) FILTER (rest / squares * size <= 1), 1e300::DOUBLE) AS rate, coalesce(arg_max(rest, size) FILTER (rest / squares * size <= 1), 0) AS rest FROM sums GROUP BY source
), d AS (
  SELECT doc_id, s.source, size, g.source_size, target, whole, coalesce(rest, 0) AS rest, (size > 0 AND size <= 2 * missing) AS able, coalesce(rate, 0) * size AS odds,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN rates r ON r.source IS NOT DISTINCT FROM s.source
), r AS (
  SELECT *, able AND odds >= 1 AS certain, CASE WHEN able AND odds < 1 AND odds > 0 THEN u / (1 - u) / (odds / (1 - odds)) END AS pareto FROM d
), o AS (
  SELECT *, coalesce(sum(CASE WHEN pareto IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY pareto ASC NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r
)
SELECT doc_id, size, source_size, target, (size * least(3, whole + CASE WHEN certain OR pareto IS NOT NULL AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
