"""Sinks.  Overwrites rely on the job commit: readers see the old or the new files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload fields stored beside a vector.
PAYLOAD = [
    "child_id",
    "parent_id",
    "corpus_id",
    "title",
    "source_file",
    "heading_path",
    "document_type",
    "source_type",
    "meeting_id",
    "meeting_name",
    "meeting_date",
    "agenda",
    "topic",
    "section_title",
    "slide_title",
    "content_type",
]


def replace_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_csv(parts: list[DataFrame], path: str) -> None:
    """One CSV of tables with different columns: the header is the union of their keys."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_logs(df: DataFrame, path: str, at: str = "created_at") -> None:
    """Append rows partitioned by day; rows of one day are written by few tasks, hot days by more."""
    dated = df.withColumn("date", F.to_date(at))
    dated.repartition("date", F.pmod(F.xxhash64(at), F.lit(8))).write.mode("append").partitionBy("date").parquet(path)


def payload_columns(df: DataFrame) -> list[Column]:
    """Payload scalars as strings; absent columns are left out, the slide number is an integer."""
    out = [F.col(name).cast("string").alias(name) for name in PAYLOAD if name in df.columns]
    if "slide_no" in df.columns:
        out.append(F.coalesce(F.col("slide_no").cast("int"), F.lit(0)).alias("slide_no"))
    return out


def write_release(index: DataFrame, path: str, release_id: str) -> None:
    """Replace the partition of one release and leave the others alone."""
    (
        index.withColumn("release_id", F.lit(release_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("release_id").parquet(path)
    )
