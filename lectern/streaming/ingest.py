"""Continuous ingest: an extension, the batch pipeline driven by a file stream.

Pages that appear below a root are kept in a table, batch by batch, and the documents they belong to are chunked anew from
all their pages; a page that comes again replaces the one before. The stream's checkpoint makes a batch run once, and a
batch that is repeated after a failure writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern import schema
from lectern.functions import models, text
from lectern.operators import slides
from lectern.sources import store
from lectern.sources.shared import cut

PAGES = "document_id long, course string, page int, text string"


def pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of pages (JSON lines)."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(path)


def follow(stream: DataFrame, tables: str, checkpoint: str, model: str = "hashed-words", embed=None, dim: int = schema.EMBED_DIM) -> StreamingQuery:
    """Keep the chunk table at `tables` in step with the stream of pages."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The same page again in one batch: the longest text stands.
        once = batch.groupBy("document_id", "course", "page").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
        once = cut(once)
        courses = sorted(r[0] for r in once.select("course").distinct().collect())
        if not courses:
            return
        mine = F.col("course").isin(courses)
        # A document is rebuilt whole, from its new pages and those that came before.
        before = store.read(spark, f"{tables}/pages", schema.PAGES).where(mine)
        pages_ = cut(before.join(once, ["document_id", "course", "page"], "left_anti").select(*schema.PAGES.names).unionByName(once.select(*schema.PAGES.names)))
        touched = pages_.join(once.select("document_id").distinct(), "document_id", "left_semi")
        fresh, now = slides.chunks(touched), F.current_timestamp()
        vector = (embed or models.embedder(dim=dim))(text.breadcrumb(F.col("course"), F.col("lecture"), F.col("section"), F.col("content")))
        fresh = fresh.withColumn("embedding", vector).withColumn("embed_model", F.lit(model)).withColumn("created_at", now).withColumn("updated_at", now)
        old = store.read(spark, f"{tables}/chunks", schema.CHUNKS).where(mine)
        store.commit(spark, tables, courses, pages=pages_, chunks=store.replace_chunks(old, store.checked(fresh, dim), touched))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
