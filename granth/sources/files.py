"""JSON-lines and report files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped, broken ones give nulls."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_report(path: str, tag: str, markdown: DataFrame, summary: DataFrame) -> None:
    """A run's table appended to a Markdown report, and its numbers beside it as JSON. Both frames have a row a system."""
    lines = [r.line for r in markdown.orderBy("line_no").collect()]
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"## {tag}\n\n" + "\n".join(lines) + "\n\n")
    with open(os.path.join(os.path.dirname(path), f"{tag}.json"), "w", encoding="utf-8") as f:
        json.dump([r.asDict() for r in summary.collect()], f, ensure_ascii=False, indent=1)
