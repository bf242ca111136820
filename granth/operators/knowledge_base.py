"""The knowledge base as tables: ingestion with exact deduplication, deletion, listings, staleness, meta values, snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.functions.text import HBLANK
from granth.runtime import read_text, write_text

SUPPORTED = (".pdf", ".docx", ".txt", ".md")
MAX_UPLOAD_MB = 50


class DuplicateDocumentError(ValueError):
    """The same bytes are in the knowledge base already; existing is the document's id."""

    def __init__(self, filename: str, existing: int | None = None):
        super().__init__(f"'{filename}' is already in the knowledge base")
        self.existing = existing


class DocumentProcessingError(ValueError):
    """Too large, or without text."""


class UnsupportedFileType(ValueError):
    """Extension that no loader reads."""


def basename(c: str):
    return F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"([^/]*)$", 1)


def extension(c: str):
    return F.lower(F.regexp_extract(basename(c), r"(\.[^.]*)$", 1))


def file_key(c: str = "sha256"):
    """sha256 as it is compared: outer blanks and letter case don't count; null if blank."""
    return F.nullif(F.lower(F.regexp_replace(c, rf"^[{HBLANK}\n]+|[{HBLANK}\n]+$", "")), F.lit(""))


def check_uploads(uploads: DataFrame) -> DataFrame:
    """One row per distinct upload, with the guards' verdict in order: extension, size, emptiness; then the logged status."""
    ext = extension("filename")
    bad = F.when(ext.isNull() | ~ext.isin(*SUPPORTED), "unsupported type").when(F.col("size_bytes") > MAX_UPLOAD_MB * 1024 * 1024, "too large").when(F.coalesce("size_bytes", F.lit(0)) <= 0, "empty")
    return uploads.dropDuplicates().select("upload_id", basename("filename").alias("filename"), ext.alias("extension"), F.when(bad.isNotNull(), "error").otherwise(F.col("status")).alias("status"), F.coalesce(bad, F.col("error")).alias("reason"))


def canonical(documents: DataFrame) -> DataFrame:
    """(doc_id, first_id, copies): the smallest document with the same file, and how many there are."""
    k = documents.select("doc_id", F.coalesce(file_key(), F.concat(F.lit("#"), F.col("doc_id").cast("string"))).alias("k"))
    g = k.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return k.join(g, "k").select("doc_id", "first_id", "copies")


def ingest(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """(doc_id, status, existing_id) of a batch: duplicate of a stored file, duplicate within the batch (first by time, then id), or added."""
    old = existing.select(file_key().alias("k"), "doc_id").where("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("old_id"))
    b = batch.select("doc_id", "created_at", F.coalesce(file_key(), F.concat(F.lit("#"), F.col("doc_id").cast("string"))).alias("k"))
    first = b.groupBy("k").agg(F.min(F.struct("created_at", "doc_id")).alias("f"))
    j = b.join(first, "k").join(old, "k", "left")
    same = F.col("f.doc_id") != F.col("doc_id")
    return j.select("doc_id", F.when(F.col("old_id").isNotNull() | same, "duplicate").otherwise("added").alias("status"), F.when(F.col("old_id").isNotNull(), F.col("old_id")).when(same, F.col("f.doc_id")).alias("existing_id"))


def delete(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the documents; all of them have doc_id."""
    gone = doc_ids.select("doc_id").where("doc_id IS NOT NULL").dropDuplicates()
    return {k: t.join(gone, "doc_id", "left_anti") for k, t in tables.items()}


def upsert(meta: DataFrame, updates: DataFrame) -> DataFrame:
    """meta with the updates' values for their keys."""
    return meta.join(updates.select("key"), "key", "left_anti").unionByName(updates)


def list_documents(documents: DataFrame) -> DataFrame:
    """Documents for a listing: no stored path, warnings unpacked, empties dropped."""
    w = F.filter(F.split(F.coalesce("warnings", F.lit("")), "\n"), lambda x: x != "")
    return documents.select("doc_id", "filename", "language", "num_pages", "num_chunks", "size_bytes", w.alias("warnings"), "created_at")


def listing_order() -> list[Column]:
    """Newest first, then by name."""
    return [F.desc("created_at"), F.asc("filename"), F.asc("doc_id")]


def new_ids(rows: DataFrame, high_water: int, order: list[str]) -> DataFrame:
    """rows with ids above the stored high-water mark, which survives deletions, so that no id is used twice.

    Ids are dense within each of the hash-ordered buckets; bucket offsets are the only thing on the driver.
    """
    b = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(256)))
    n = {r._b: r["count"] for r in b.groupBy("_b").count().collect()}
    starts, at = [], high_water
    for k in range(256):
        starts.append((k, at))
        at += n.get(k, 0)
    off = rows.sparkSession.createDataFrame(starts, "_b long, _s long")
    return b.join(F.broadcast(off), "_b").withColumn("id", F.col("_s") + F.row_number().over(W.partitionBy("_b").orderBy(*order))).drop("_b", "_s")


class Snapshots:
    """Whole-state commits on any storage: every table is a list of folders, and one small manifest names them all.

    A commit writes new folders and then replaces the manifest, so readers see all of it or nothing. Tables that a commit does not
    name stay as they are; append adds a folder to a table without reading it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict[str, list[str]]:
        return json.loads(read_text(self.spark, f"{self.path}/CURRENT.json") or "{}")

    def commit(self, tables: dict[str, DataFrame], append: bool = False, replace: dict[str, DataFrame] | None = None) -> str:
        """Write tables (append: in addition to what they hold), and tables in replace in place of what they hold."""
        version, at = uuid.uuid4().hex, self.manifest()
        for name, df, more in [(k, v, append) for k, v in tables.items()] + [(k, v, False) for k, v in (replace or {}).items()]:
            folder = f"{version}/{name}"
            df.write.parquet(f"{self.path}/{folder}")
            at[name] = [*(at.get(name, []) if more else []), folder]
        write_text(self.spark, f"{self.path}/CURRENT.json", json.dumps(at))
        return version

    def read(self, name: str) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in self.manifest()[name]]
        return self.spark.read.schema(self.spark.read.parquet(folders[0]).schema).parquet(*folders)
