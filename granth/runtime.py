"""Session helpers shared by every operator: reading tables, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space, as a Java / RE2 character class body (fixed values of the Unicode standard).
BLANK = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Above this many bytes a side is never broadcast by this library.
BROADCAST_BYTES = 8 << 20


#: Paths that materialise() wrote in this process.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the session runs in one
    process (tests, local mode). A cluster without the setting is an error: its executors share no folder of the driver's."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"granth-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at) if _settable(spark) else None
    return at


def _settable(spark: SparkSession) -> bool:
    try:
        return bool(spark.conf.isModifiable("spark.checkpoint.dir"))
    except Exception:
        return False


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write once to the shared folder and read again: cuts lineage, survives lost executors, keeps columns prunable."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by clear()."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def _files(spark: SparkSession, path: str):
    """(file system, path) of a path on whatever storage its scheme names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small UTF-8 file, or None if there is none."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it and renamed, so that readers see the old content or the new one."""
    fs, at = _files(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    context.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, at, _overwrite(spark))


def _overwrite(spark: SparkSession):
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    out = spark.sparkContext._gateway.new_array(rename, 1)
    out[0] = rename.OVERWRITE
    return out


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only if a count proves that the side stays under limit; df should be materialised."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def meta_int(spark: SparkSession, sf_dir: str, key: str, default: int) -> int:
    """Integer value of the key/value table; default where the key is missing or not a number."""
    row = table(spark, sf_dir, "meta").where(F.col("key") == key).agg(F.max(F.expr("try_cast(value AS INT)"))).first()
    return default if row is None or row[0] is None else int(row[0])


def clear(spark: SparkSession) -> int:
    """Delete what materialise() wrote for this session and return how many tables that were; results must have been read before."""
    jvm, n = spark.sparkContext._jvm, 0
    while _WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        n += 1
    return n
