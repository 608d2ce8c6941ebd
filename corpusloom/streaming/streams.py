"""Log metrics, duplicate-free log ingest and incremental document ingest.

Lateness rules are this library's own: one hour by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.chunking import child_rows, chunk_documents
from corpusloom.operators.logs import LOW_SCORE, log_metrics, quality_state
from corpusloom.sources.documents import replace_documents

LATENESS = "1 hour"


def windowed_metrics(logs: DataFrame, size: str = "1 hour", low_score: float = LOW_SCORE, lateness: str = LATENESS) -> DataFrame:
    """Questions, no-hit and low-confidence answers per tumbling window."""
    rows = log_metrics(logs.withColumn("created_at", F.col("created_at").cast("timestamp"))).withWatermark("created_at", lateness)
    state = quality_state(low_score=low_score)
    counted = rows.groupBy(F.window("created_at", size)).agg(
        F.count("*").alias("questions"), F.count_if(state == "no_sources").alias("no_hit"), F.count_if(state == "low_confidence").alias("low_confidence")
    )
    return counted.select(F.col("window.start").alias("window_start"), "questions", "no_hit", "low_confidence")


def windowed_counts(events: DataFrame, at: str = "created_at", size: str = "1 hour", lateness: str = LATENESS, *keys: str) -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.groupBy(F.window(at, size), *keys).agg(F.count("*").alias("questions")).select(F.col("window.start").alias("window_start"), *keys, "questions")


def first_deliveries(logs: DataFrame, key: str = "id", at: str = "created_at", lateness: str = LATENESS) -> DataFrame:
    """Logs without redelivered ids (state is kept for the lateness only)."""
    return logs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def append_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table with exactly-once file commits."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_documents(
    documents: DataFrame, prepare: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, stream: str = "documents", newest_by: str | None = None, deleted: str | None = None
) -> StreamingQuery:
    """Chunk landed documents; a document that lands again replaces its own chunks.

    ``prepare`` turns landed rows into (corpus_id, source_file, title, text, chunking).  Rows with a true
    ``deleted`` column remove their document.  Read the result with ``sources.documents.read_documents``:
    one snapshot of all committed batches.  A batch that runs again changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        replace_documents(rows, path, lambda new: child_rows(chunk_documents(prepare(new))), stream=stream, number=number, newest_by=newest_by, deleted=deleted)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
