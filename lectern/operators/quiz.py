"""Which sections a quiz asks about, how often, and which of its questions stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text


def buckets(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, doc_path, course, lecture, label, first_ordinal, last_ordinal, n_chunks: one row a section.

    documents: id, doc_path, lecture. Chunks without a section form one bucket a document, named by its slides.
    """
    named = chunks.select("document_id", "course", "section", "ordinal").join(documents.select(F.col("id").alias("document_id"), "doc_path", "lecture"), "document_id")
    found = named.groupBy("document_id", "doc_path", "course", "lecture", "section").agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count("*").alias("n_chunks"))
    label = F.coalesce(F.nullif("section", F.lit("")), text.run_label(F.col("first_ordinal"), F.col("last_ordinal")))
    return found.select("document_id", "doc_path", "course", "lecture", label.alias("label"), "first_ordinal", "last_ordinal", "n_chunks")


def planned(found: DataFrame, run: int = schema.RUN_CHUNKS) -> DataFrame:
    """buckets with long runs of slides cut into runs of `run`; key identifies the result."""
    long = F.col("label").startswith("slides ") & (F.col("n_chunks") > run)
    starts = F.when(long, F.sequence("first_ordinal", "last_ordinal", F.lit(run).cast(found.schema["first_ordinal"].dataType))).otherwise(F.array("first_ordinal"))
    out = found.withColumn("cut", long).withColumn("start", F.explode(starts))
    end = F.when(F.col("cut"), F.least(F.col("start") + run - 1, F.col("last_ordinal"))).otherwise(F.col("last_ordinal"))
    label = F.when(F.col("cut"), text.run_label(F.col("start"), end)).otherwise(F.col("label"))
    n = F.when(F.col("cut"), end - F.col("start") + 1).otherwise(F.col("n_chunks")).cast("long")
    key = F.concat_ws(":", F.col("document_id").cast("string"), F.col("start").cast("string"))
    return out.select("document_id", "doc_path", "course", "lecture", label.alias("label"), F.col("start").alias("first_ordinal"), end.alias("last_ordinal"), n.alias("n_chunks"), key.alias("key"))


def allocate(plan: DataFrame, n_questions: Column | int, *scope: str) -> DataFrame:
    """plan with quota: questions of each bucket, within each scope.

    One each, and the rest in proportion to n_chunks by largest remainders; ties to the larger bucket, then to the
    earlier (doc_path, first_ordinal, key). With fewer questions than buckets the largest get one each.
    Shares are compared as whole numbers: spare * size div and mod total.
    """
    n = F.greatest(n_questions if isinstance(n_questions, Column) else F.lit(n_questions), F.lit(0)).cast("long")
    order = ["doc_path", "first_ordinal", "key"]
    all_ = Window.partitionBy(*scope)
    t = plan.withColumn("buckets", F.count("*").over(all_)).withColumn("total", F.sum("n_chunks").over(all_)).withColumn("spare", n - F.col("buckets"))
    t = t.withColumn("by_size", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("n_chunks"), *order)))
    t = t.withColumn("share", F.expr("spare * n_chunks div total")).withColumn("rest", F.expr("spare * n_chunks % total"))
    t = t.withColumn("by_rest", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("rest"), F.desc("n_chunks"), *order)))
    left = F.col("spare") - F.sum("share").over(all_)
    t = t.withColumn("left", left)
    few = F.when(F.col("by_size") <= n, 1).otherwise(0)
    many = 1 + F.col("share") + F.when(F.col("by_rest") <= F.col("left"), 1).otherwise(0)
    return t.withColumn("quota", F.when(F.col("spare") < 0, few).otherwise(many).cast("long")).drop("buckets", "total", "spare", "by_size", "share", "rest", "by_rest", "left")


def bucket_texts(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """key, content: the chunks of each bucket in order, with blank lines between."""
    held = plan.select("key", "document_id", F.explode(F.sequence("first_ordinal", "last_ordinal")).alias("ordinal")).join(chunks.select("document_id", "ordinal", "content"), ["document_id", "ordinal"])
    return held.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda r: r["content"]), "\n\n").alias("content"))


def judged(questions: DataFrame, chosen: DataFrame) -> DataFrame:
    """questions with status: bad_section, over_quota, unverified or kept, tested in that order.

    questions: scope, pos, section_index, supporting_quote and more; chosen: scope, section_index, quota, content. A
    question is over quota if enough earlier ones of its section had valid quotes.
    """
    t = questions.join(chosen.select("scope", "section_index", "quota", "content"), ["scope", "section_index"], "left")
    # A section that is owed nothing has all its questions over quota, whatever they quote: no text is compared for it.
    valid = (F.coalesce("quota", F.lit(0)) > 0) & F.coalesce(text.quote_supported(F.col("supporting_quote"), F.col("content")), F.lit(False))
    before = Window.partitionBy("scope", "section_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("valid", valid).withColumn("written", F.coalesce(F.sum(F.col("valid").cast("int")).over(before), F.lit(0)))
    status = F.when(F.col("quota").isNull(), "bad_section").when(F.col("written") >= F.col("quota"), "over_quota").when(~F.col("valid"), "unverified").otherwise("kept")
    return t.withColumn("status", status).drop("valid", "written")


def outstanding(chosen: DataFrame, kept: DataFrame) -> DataFrame:
    """chosen with what is still owed to each section, for sections owed anything; kept: key of each kept question."""
    done = kept.groupBy("key").agg(F.count("*").alias("done"))
    left = chosen.join(done, "key", "left").withColumn("quota", F.col("quota") - F.coalesce("done", F.lit(0))).drop("done").where("quota > 0")
    return left


def report(status: DataFrame, available: DataFrame) -> DataFrame:
    """Counters and rates by scope. status: scope, status, key; available: scope, sections_available."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    t = status.groupBy("scope").agg(
        F.count("*").alias("n_generated"), n("kept").alias("n_kept"), n("bad_section").alias("n_dropped_bad_section"), n("unverified").alias("n_dropped_unverified"), n("over_quota").alias("n_dropped_over_quota"),
        F.countDistinct(F.when(F.col("status") == "kept", F.col("key"))).alias("sections_covered"),
    )
    valid = F.col("n_generated") - F.col("n_dropped_unverified") - F.col("n_dropped_bad_section")
    t = t.join(available, "scope").withColumn("coverage", F.round(F.col("sections_covered") / F.col("sections_available"), 4))
    return t.withColumn("quote_validity", F.when(F.col("n_generated") > 0, F.round(valid / F.col("n_generated"), 4)))


def shortfall(t: DataFrame, requested: Column) -> DataFrame:
    """t with short: fewer questions kept than asked for, or than there were sections to ask about."""
    return t.withColumn("short", F.col("n_kept") < F.least(requested, F.col("sections_available")))
