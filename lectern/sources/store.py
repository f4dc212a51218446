"""Tables as Parquet folders under one root, and what an ingest does to them.

Rows lie in <table>/course=<c>/version=<v>. Which versions count is said by the newest manifest, one small file that names
the folders of every table. A commit writes new folders for the courses that it touches, then one manifest,
by a rename that fails if another commit was faster. Readers so see all tables of the old state or
all of the new one, a failed run leaves the old state, and other courses are neither read nor written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schema

LOG = "_manifests"


class _Files:
    """The file system of a path, by way of Spark's own configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.hadoop = spark.sparkContext, spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = self.sc._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(root).getFileSystem(self.conf)

    def names(self, pattern: str) -> list[str]:
        return sorted(f.getPath().toUri().getPath() for f in self.fs.globStatus(self.hadoop.Path(pattern)) or [])

    def text(self, path: str) -> str:
        opened = self.fs.open(self.hadoop.Path(path))
        try:
            return self.sc._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()

    def put(self, path: str, body: str) -> None:
        """Write a file that must not exist yet; it appears whole."""
        draft = self.hadoop.Path(f"{path}.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        target = self.fs.makeQualified(self.hadoop.Path(path))
        rename = self.sc._gateway.new_array(self.hadoop.Options.Rename, 0)
        self.hadoop.FileContext.getFileContext(target.toUri(), self.conf).rename(self.fs.makeQualified(draft), target, rename)

    def delete(self, path: str) -> None:
        self.fs.delete(self.hadoop.Path(path), True)


def _manifests(files: _Files, root: str) -> list[str]:
    return [n for n in files.names(f"{root}/{LOG}/*") if n.endswith(".json")]


def _current(files: _Files, root: str) -> tuple[int, dict[str, list[str]]]:
    """Number and content of the newest manifest: for each table its folders, relative to the table."""
    found = _manifests(files, root)
    if not found:
        return 0, {}
    return int(found[-1].rsplit("/", 1)[1].split(".")[0]), json.loads(files.text(found[-1]))


def read(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """The table at path, partitioned by course; empty if it was never written."""
    root, name = path.rstrip("/").rsplit("/", 1)
    folders = _current(_Files(spark, root), root)[1].get(name, [])
    if not folders:
        return spark.createDataFrame([], fields)
    full = T.StructType([*fields.fields, T.StructField("version", T.StringType())])
    return spark.read.schema(full).option("basePath", path).parquet(*(f"{path}/{f}" for f in folders)).select(*fields.names)


def commit(spark: SparkSession, root: str, courses: list[str], **tables: DataFrame) -> None:
    """Put the given tables in the place of what these courses had there; each holds all rows of the courses, or none.

    A course without rows has none afterwards. Two commits at once: the slower one fails and changes nothing.
    """
    files, version = _Files(spark, root), uuid.uuid4().hex
    number, folders = _current(files, root)
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    replaced = {f"course={escape(c)}" for c in courses}
    fresh = dict(folders)
    for name, df in tables.items():
        df.where(F.col("course").isin(courses)).withColumn("version", F.lit(version)).write.mode("append").partitionBy("course", "version").parquet(f"{root}/{name}")
        written = ["/".join(p.rsplit("/", 2)[1:]) for p in files.names(f"{root}/{name}/course=*/version={version}")]
        fresh[name] = sorted([f for f in folders.get(name, []) if f.split("/")[0] not in replaced] + written)
    files.put(f"{root}/{LOG}/{number + 1:012d}.json", json.dumps(fresh))
    _forget(files, root)


def _forget(files: _Files, root: str) -> None:
    """Delete folders that neither of the two newest manifests names, for readers that began before the last commit."""
    found = _manifests(files, root)
    kept = [json.loads(files.text(m)) for m in found[-2:]]
    used = {(t, f) for m in kept for t, folders in m.items() for f in folders}
    for old in found[:-2]:
        for t, folders in json.loads(files.text(old)).items():
            for f in folders:
                if (t, f) not in used:
                    files.delete(f"{root}/{t}/{f}")
        files.delete(old)


def write_json(spark: SparkSession, path: str, body: dict) -> None:
    """A result of bounded size as one JSON file, which must not exist yet."""
    _Files(spark, path).put(path, json.dumps(body, indent=2, ensure_ascii=False, default=str))


def checked(chunks: DataFrame, dim: int = schema.EMBED_DIM) -> DataFrame:
    """chunks; a vector of another length than dim fails the write."""
    return chunks.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} dimensions")).cast("array<float>")))


def new_files(files: DataFrame, documents: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """files whose bytes the course does not have yet, and duplicates with the path they are known by.

    force lets a file through that is stored under its own path. Of equal new files of a course the first path stays.
    Applied to hashes, before any text is read.
    """
    known = documents.select("course", "content_hash", F.col("doc_path").alias("known_as"))
    t = files.join(known, ["course", "content_hash"], "left")
    fresh = F.col("known_as").isNull() | (F.lit(force) & (F.col("known_as") == F.col("doc_path")))
    first = t.where(fresh).groupBy("course", "content_hash").agg(F.min("doc_path").alias("first_path"))
    t = t.join(first, ["course", "content_hash"], "left").withColumn("known_as", F.when(fresh & (F.col("doc_path") != F.col("first_path")), F.col("first_path")).otherwise(F.col("known_as")))
    go = F.col("known_as").isNull() | (F.lit(force) & (F.col("known_as") == F.col("doc_path")))
    return t.where(go).drop("known_as", "first_path"), t.where(~go).drop("first_path")


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new rows by (course, doc_path): kept ids and first ingest time, all else fresh."""
    key = ["course", "doc_path"]
    was = old.select(*key, F.col("id").alias("old_id"), F.col("ingested_at").alias("first_at"))
    fresh = new.join(was, key, "left").withColumn("id", F.coalesce("old_id", "id")).withColumn("ingested_at", F.coalesce("first_at", "ingested_at")).select(*old.columns)
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(fresh)


def replace_chunks(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """old with all chunks of `documents` (document_id) replaced by new; what an ordinal had first, created_at, is kept."""
    key = ["document_id", "ordinal"]
    was = old.select(*key, F.col("created_at").alias("first_at"))
    fresh = new.join(was, key, "left").withColumn("created_at", F.coalesce("first_at", "created_at")).select(*old.columns)
    return old.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(*old.columns).unionByName(fresh)


def embedding_models(chunks: DataFrame) -> DataFrame:
    """course, models: courses whose vectors come from several models cannot be searched as one."""
    return chunks.groupBy("course").agg(F.countDistinct("embed_model").alias("models"))
