"""Pages to slides to chunks. All grouping is by document; nothing is gathered on one machine.

pages: document_id, course, page (from 1), text; further columns are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schema
from lectern.functions import text


def footers(pages: DataFrame) -> DataFrame:
    """document_id, footer: the line (page numbers aside) that stands on most pages, if on enough of them."""
    # Every page also has an empty line, which counts the pages in the same pass.
    bare = F.transform(text.lines(F.col("text")), lambda x: text.without_page_number(x, stripped=True))
    seen = pages.select("document_id", "page", F.explode(F.array_distinct(F.concat(F.coalesce(bare, F.array().cast("array<string>")), F.array(F.lit(""))))).alias("footer"))
    counts = seen.groupBy("document_id", "footer").agg(F.countDistinct("page").alias("n"))
    line = F.when(F.col("footer") != "", F.struct((-F.col("n")).alias("n"), "footer"))
    best = counts.groupBy("document_id").agg(F.min(line).alias("b"), F.max(F.when(F.col("footer") == "", F.col("n"))).alias("pages"))
    share = -F.col("b.n") / F.col("pages")
    return best.where(share >= schema.FOOTER_MIN_SHARE).select("document_id", F.col("b.footer").alias("footer"))


def parse(pages: DataFrame, footer: DataFrame | None) -> DataFrame:
    """Slides: title (null if none) and body instead of text. footer: as footers() gives it, None for no removal."""
    found = F.filter(text.lines(F.col("text")), lambda x: F.col("footer").isNull() | (text.without_page_number(x, stripped=True) != F.col("footer")))
    slides = (pages.join(footer, "document_id", "left") if footer is not None else pages.withColumn("footer", F.lit(None).cast("string"))).withColumn("lines", found)
    own_number = F.concat(F.lit("^"), F.col("page").cast("string"), F.lit(r"\s*"))
    title = text.strip(F.regexp_replace(F.get("lines", F.lit(0)), own_number, F.lit("")))
    return slides.withColumn("title", F.nullif(title, F.lit(""))).withColumn("body", F.array_join(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), "\n")).drop("text", "footer", "lines")


def with_sections(slides: DataFrame) -> DataFrame:
    """section: what the last outline slide with a single line announced; such slides lose their body."""
    marker = F.coalesce(F.lower("title").isin(*schema.SECTION_MARKERS), F.lit(False))
    named = text.lines(F.col("body"))
    so_far = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(marker & (F.size(named) == 1), F.get(named, F.lit(0))), ignorenulls=True).over(so_far)
    return slides.withColumn("section", section).withColumn("body", F.when(marker, "").otherwise(F.col("body")))


def lectures(slides: DataFrame) -> DataFrame:
    """document_id, lecture: the identifier on the first slide."""
    head = text.join_parts("\n", F.col("title"), F.col("body"))
    return slides.where("page = 1").select("document_id", text.lecture_id(head).alias("lecture"))


def packed_lines(title: Column, body: Column, limit: int = schema.MAX_TOKENS) -> Column:
    """The body's lines in order, packed into parts of at most limit words, each led by the title.

    A fold over the lines: words add up, so a part's count is that of its title and lines.
    """
    head = F.coalesce(text.word_count(title), F.lit(0))
    prefix = F.coalesce(F.concat(F.nullif(title, F.lit("")), F.lit("\n")), F.lit(""))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def add(state: Column, line: Column) -> Column:
        n, held = text.word_count(line), state["open"].isNotNull()
        over = held & (head + state["n"] + n > limit)
        return F.struct(
            F.when(over, F.concat(state["parts"], F.array(state["open"]))).otherwise(state["parts"]).alias("parts"),
            F.when(held & ~over, F.concat_ws("\n", state["open"], line)).otherwise(line).alias("open"),
            F.when(over, n).otherwise(state["n"] + n).alias("n"),
        )

    done = lambda s: F.when(s["open"].isNull(), s["parts"]).otherwise(F.concat(s["parts"], F.array(s["open"])))
    return F.transform(F.aggregate(F.split(body, LINES), start, add, done), lambda p: F.concat(prefix, p))


LINES = text.LINE_BREAK


def split_by_tokenizer(slides: DataFrame, count_tokens: Callable[[pd.Series], pd.Series], limit: int = schema.MAX_TOKENS) -> DataFrame:
    """slides with parts, for a tokenizer whose counts do not add up; count_tokens works on a series of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for title, body in zip(b["title"], b["body"], strict=True):
                prefix, whole = f"{title}\n" if title else "", "\n".join(x for x in (title, body) if x)
                if count_tokens(pd.Series([whole])).iloc[0] <= limit:
                    parts.append([whole])
                    continue
                out, held = [], []
                for line in body.split("\n"):
                    if held and count_tokens(pd.Series([prefix + "\n".join([*held, line])])).iloc[0] > limit:
                        out.append(prefix + "\n".join(held))
                        held = []
                    held.append(line)
                parts.append([*out, prefix + "\n".join(held)])
            counts = [[int(n) for n in count_tokens(pd.Series(p))] for p in parts]
            yield b.assign(parts=parts, counts=counts)

    more = [T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    return slides.mapInPandas(run, T.StructType([*slides.schema.fields, *more]))


def chunks(pages: DataFrame, footer: DataFrame | None = None, remove_footer: bool = True, count_tokens: Callable | None = None) -> DataFrame:
    """document_id, course, lecture, section, ordinal, page, content, token_count.

    footer: given ones instead of those detected. count_tokens: a tokenizer on pandas series; words by default.
    """
    # All that follows works within documents: one exchange by document serves every step.
    pages = pages.repartition("document_id")
    if footer is None and remove_footer:
        footer = footers(pages)
    slides = with_sections(parse(pages, footer if remove_footer else None))
    head = text.join_parts("\n", F.col("title"), F.col("body"))
    first = F.max(F.when(F.col("page") == 1, text.lecture_id(head))).over(Window.partitionBy("document_id"))
    slides = slides.withColumn("lecture", first)
    full = slides.where(~text.is_blank(F.col("body"))).withColumn("content", text.join_parts("\n", F.col("title"), F.col("body")))
    same = Window.partitionBy("document_id", "content").orderBy("page")
    full = full.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")
    if count_tokens is None:
        full = full.withColumn("words", text.word_count(F.col("content")))
        fits = F.col("words") <= schema.MAX_TOKENS
        full = full.withColumn("parts", F.when(fits, F.array("content")).otherwise(packed_lines(F.col("title"), F.col("body"))))
        full = full.withColumn("counts", F.when(fits, F.array("words")).otherwise(F.transform("parts", text.word_count)))
    else:
        full = split_by_tokenizer(full, count_tokens)
    parts = full.withColumn("whole", F.size("parts") == 1).select("document_id", "course", "lecture", "section", "page", "whole", F.posexplode(F.arrays_zip("parts", "counts")).alias("part", "p"))
    parts = parts.where(~F.col("whole") | (F.col("p.counts") >= schema.MIN_TOKENS))
    order = Window.partitionBy("document_id").orderBy("page", "part")
    out = parts.withColumn("ordinal", F.row_number().over(order) - 1)
    return out.select("document_id", "course", "lecture", "section", "ordinal", F.col("page").cast("int").alias("page"), F.col("p.parts").alias("content"), F.col("p.counts").alias("token_count"))


def chunk_documents(documents: DataFrame, pages: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Chunks of slide decks, and the documents of other types with the reason they have none.

    documents: document_id, doc_type.
    """
    decks = documents.where("doc_type = 'slides'").select("document_id")
    unknown = ~F.col("doc_type").isin(*schema.DOC_TYPES) | F.col("doc_type").isNull()
    others = documents.where("doc_type IS NULL OR doc_type <> 'slides'").withColumn("reason", F.when(unknown, "unknown document type").otherwise("no chunking strategy for this document type"))
    return chunks(pages.join(decks, "document_id", "left_semi"), **how), others
