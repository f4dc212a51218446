"""Files of a corpus: one directory a course, hashed before they are read as text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schema
from lectern.functions import text

TEXT_SUFFIXES, PDF = ("md", "markdown", "txt"), "pdf"


FOUND = "rel_path string, content binary, name string, suffix string"


def _concealed(fs, hadoop, base: str) -> tuple[list[str], list[str]]:
    """Folders and files below base that Spark's readers pass over by name but that are no hidden files: folders that begin with
    a dot or an underscore, and files that begin with an underscore. Names only, as Spark's own file index lists them."""
    folders, files, todo = [], [], [hadoop.Path(base)]
    while todo:
        for f in fs.listStatus(todo.pop()):
            name = f.getPath().getName()
            if f.isDirectory():
                todo.append(f.getPath())
                if name[0] in "._":
                    folders.append(f.getPath().toString())
            elif name[0] == "_" and not name.startswith(("_metadata", "_common_metadata")) and "=" not in name:
                files.append(f.getPath().toString())
    return folders, files


def _opened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content of files that Spark's readers refuse by their name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            out = []
            for p in b["path"]:
                # A local path has no host; others are named by their whole address.
                where, inside = (fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", p)) if p.startswith(("file:", "/")) else fs.FileSystem.from_uri(p)
                with where.open_input_file(inside) as f:
                    out.append(f.read())
            yield pd.DataFrame({"path": b["path"], "content": out})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(64, len(paths))).mapInPandas(run, "path string, content binary")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, content, name, suffix of every file below root but those whose name begins with a dot. A missing root has no files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], FOUND)
    base = fs.makeQualified(path).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^[a-z]+:(?://[^/]*)?", "")
    read = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select(plain.alias("path"), "content")
    found = read(root)
    folders, files = _concealed(fs, hadoop, root)
    for folder in folders:
        # Only what lies in no further such folder, which is read by itself.
        inside = hadoop.Path(folder).toUri().getPath()
        deeper = F.substring("path", len(inside) + 1, 1 << 20).rlike(r"/[._][^/]*/")
        found = found.unionByName(read(re.sub(r"([\[\]{}*?\\])", r"\\\1", folder)).where(~deeper))
    if files:
        found = found.unionByName(_opened(spark, files).select(plain.alias("path"), "content"))
    t = found.select(F.substring("path", len(base) + 1, 1 << 20).alias("rel_path"), "content").withColumn("name", F.element_at(F.split("rel_path", "/"), -1))
    return t.where(~F.col("name").startswith(".")).withColumn("suffix", F.lower(F.regexp_extract("name", r"(?s).\.([^.]+)$", 1)))


def discover(files: DataFrame, course: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of the kinds that can be read, by path, and the others. course: a directory anywhere on the path."""
    known = F.col("suffix").isin(*TEXT_SUFFIXES, PDF)
    keep = F.concat(F.lit("/"), "rel_path", F.lit("/")).contains(f"/{course}/") if course else F.lit(True)
    return files.where(known & keep).orderBy("rel_path"), files.where(~known).select("rel_path", "suffix")


def identified(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files with course, doc_path, content_hash (of the bytes as delivered) and doc_type, and rejects with a reason."""
    parts = F.split("rel_path", "/")
    reason = F.when(~F.col("suffix").isin(*TEXT_SUFFIXES, PDF), "unsupported file type").when(F.size(parts) < 2, "no course directory")
    t = files.withColumn("reason", reason)
    good = t.where("reason IS NULL").drop("reason").withColumn("course", F.get(parts, F.lit(0))).withColumn("doc_path", F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/"))
    return good.withColumn("content_hash", F.sha2("content", 256)).withColumn("doc_type", text.doc_type(F.col("doc_path"))), t.where("reason IS NOT NULL").select("rel_path", "reason")


def pdf_reader() -> Callable[[bytes], list[str]]:
    """Pages of a PDF by pypdf, where that is installed."""
    import io

    from pypdf import PdfReader

    return lambda data: [(p.extract_text() or "") for p in PdfReader(io.BytesIO(data)).pages]


def loaded(files: DataFrame, reader: Callable[[], Callable[[bytes], list[str]]] = pdf_reader, raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """files with clean pages (array of texts; a text file is one page) instead of content, and rejects with a reason.

    Bytes that are not UTF-8 become replacement characters. raw: pages as they are, also of files without text.
    """
    fields = [f for f in files.schema.fields if f.name != "content"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = None
        for b in batches:
            pages, errors = [], []
            for suffix, data in zip(b["suffix"], b["content"], strict=True):
                try:
                    if suffix == PDF:
                        pdf = pdf or reader()
                        pages.append(pdf(bytes(data)))
                    else:
                        pages.append([bytes(data).decode(errors="replace")])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a file that cannot be read is rejected with its reason
                    pages.append([])
                    errors.append(str(e)[:200] or type(e).__name__)
            yield b.drop(columns=["content"]).assign(pages=pages, reason=errors)

    out = files.mapInPandas(read, T.StructType([*fields, T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())]))
    if raw:
        return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL").select("rel_path", "reason")
    out = out.withColumn("pages", F.transform("pages", text.clean))
    empty = ~F.exists("pages", lambda p: p != "")
    out = out.withColumn("reason", F.coalesce("reason", F.when(empty, F.lit("no text; likely a scan"))))
    return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL").select("rel_path", "reason")


def pages(documents: DataFrame) -> DataFrame:
    """document_id, course, page, text from rows with pages; the id is a hash of (course, doc_path)."""
    return documents.select(document_id().alias("document_id"), "course", F.posexplode("pages").alias("p", "text")).select("document_id", "course", (F.col("p") + 1).alias("page"), "text")


def document_id():
    return F.xxhash64("course", "doc_path")


def profile_text(pages_: F.Column) -> F.Column:
    """One text of all pages that are not empty, each after a marker with its number."""
    marked = F.transform(pages_, lambda p, i: F.when(text.strip(p) != "", F.concat(F.lit("<!-- page "), (i + 1).cast("string"), F.lit(" -->\n"), text.strip(p))))
    return F.array_join(F.filter(marked, lambda p: p.isNotNull()), "\n\n")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions from a JSON array."""
    return spark.read.schema(schema.GOLD).option("multiLine", True).json(path)
