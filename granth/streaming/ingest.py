"""Live ingestion: streams of documents or of files, deduplicated against the current snapshot and committed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granth.knowledge import KnowledgeBase
from granth.operators import knowledge_base as kb
from granth.runtime import materialise
from granth.sources import loaders


def start(stream: DataFrame, snapshots: kb.Snapshots, checkpoint: str, derive: Callable[[DataFrame], dict[str, DataFrame]] | None = None):
    """Running query that adds new documents of (doc_id, sha256, created_at, ...) to the snapshot's 'documents' table.

    A micro-batch appends its rows; the other tables stay, but for those that derive gives for the new documents (their chunks,
    their vectors), which are appended in the same commit. A batch that is replayed after a failure finds its files present and
    adds nothing, so each document is added once.
    """

    def add(batch: DataFrame, _: int) -> None:
        old = snapshots.read("documents")
        batch = materialise(batch, "batch")
        status = kb.ingest(old, batch).where("status = 'added'").select("doc_id")
        new = materialise(batch.join(status, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*old.columns), "new")
        if not new.isEmpty():
            snapshots.commit({"documents": new} | (derive(new) if derive else {}), append=True)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_folder(spark: SparkSession, path: str, base: KnowledgeBase, checkpoint: str):
    """Running query that loads, chunks, embeds and commits the files that appear in a folder."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.writeStream.foreachBatch(lambda batch, _: base.add_pages(loaders.pages(batch)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, time: str, key: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Windowed counts by key under a watermark."""
    t = F.col(time).cast("timestamp")
    return events.withColumn("_t", t).withWatermark("_t", lateness).groupBy(F.window("_t", window), key).agg(F.count("*").alias("n"))
