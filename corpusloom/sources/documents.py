"""Chunks of documents that change: keyed replace, deletions, one snapshot for readers.

Chunks are appended in parts and never rewritten.  A manifest says for each document which part holds its
chunks and the hash of the content they were made of.  A batch writes the chunks of new and changed
documents as one part, then commits manifest rows for them, tombstones for deleted ones, and its own
number.  Readers join the parts with the manifest of one commit, so they see all of a batch or nothing.
Manifest rows are kept as increments; when there are many they are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.commits import newest, update

#: Increments after which the manifest is merged into one table.
MERGE_AFTER = 16
_MANIFEST = "doc_key string, content_hash string, part string, deleted boolean, version long"


def _key(keys: tuple[str, ...]) -> Column:
    return F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))


def _manifest(spark: SparkSession, entry: dict | None) -> DataFrame:
    """(doc_key, content_hash, part, deleted, version): the newest row of each document."""
    if not entry or not entry["increments"]:
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema(_MANIFEST).parquet(*entry["increments"])
    return rows.groupBy("doc_key").agg(F.max_by(F.struct("content_hash", "part", "deleted"), "version").alias("r"), F.max("version").alias("version")).select("doc_key", "r.*", "version")


def replace_documents(
    landed: DataFrame,
    folder: str,
    make_chunks: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = ("corpus_id", "source_file"),
    content: tuple[str, ...] = ("text",),
    stream: str = "batch",
    number: int = 0,
    newest_by: str | None = None,
    deleted: str | None = None,
) -> int:
    """Put a batch of landed documents in the place of what is stored; returns the commit's number.

    ``make_chunks`` turns landed rows into chunk rows that keep the ``keys``.  A document whose
    ``content`` columns have the stored hash stays as it is.  Rows with a true ``deleted`` column remove
    theirs.  Of several rows of one document the largest ``newest_by`` counts (without it: the row
    with the largest content hash).  A ``number`` of a ``stream`` that was committed before changes
    nothing, so a batch may run again after a failure.
    """
    spark = landed.sparkSession
    log, part = f"{folder}/_commits", f"{stream}-{number}-{uuid.uuid4().hex[:8]}"
    if _seen(newest(spark, log)[1], stream, number):
        return newest(spark, log)[0]
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    digest = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in content])), 256)
    marked = landed.withColumn("_key", _key(keys)).withColumn("_gone", gone).withColumn("_hash", digest)
    order = [F.col(newest_by).desc_nulls_last()] if newest_by else []
    last = Window.partitionBy("_key").orderBy(*order, F.col("_gone"), F.col("_hash").desc())
    final = marked.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    def commit(entry: dict | None) -> dict | None:
        if _seen(entry, stream, number):
            return None
        # only the batch's own documents are looked up
        names = final.select("_key").withColumnRenamed("_key", "doc_key")
        stored = _manifest(spark, entry).join(names, "doc_key", "left_semi").select(F.col("doc_key").alias("_key"), F.col("content_hash").alias("_old"), F.col("deleted").alias("_was"))
        compared = final.join(stored, "_key", "left")
        known = F.col("_old").isNotNull() & ~F.col("_was")
        changed = compared.filter(F.when(F.col("_gone"), known).otherwise(~known | (F.col("_old") != F.col("_hash")))).drop("_old", "_was")
        rows = changed.filter(~F.col("_gone")).drop("_key", "_gone", "_hash")
        own = f"{part}-{uuid.uuid4().hex[:8]}"
        chunks = make_chunks(rows)
        chunks.withColumn("doc_key", _key(keys)).withColumn("part", F.lit(own)).write.partitionBy("part").mode("append").parquet(f"{folder}/chunks")
        version = (entry["version"] if entry else 0) + 1
        increment = f"{folder}/manifest/{own}"
        changed.select(
            F.col("_key").alias("doc_key"), F.when(~F.col("_gone"), F.col("_hash")).alias("content_hash"), F.lit(own).alias("part"), F.col("_gone").alias("deleted"), F.lit(version).cast("long").alias("version")
        ).write.parquet(increment)
        increments = [*(entry["increments"] if entry else []), increment]
        if len(increments) > MERGE_AFTER:
            merged = f"{folder}/manifest/merged-{own}"
            _manifest(spark, {"increments": increments}).write.parquet(merged)
            increments = [merged]
        applied = {**(entry["applied"] if entry else {}), stream: number}
        return {"version": version, "increments": increments, "applied": applied}

    return update(spark, log, commit)


def _seen(entry: dict | None, stream: str, number: int) -> bool:
    return bool(entry) and entry["applied"].get(stream, -1) >= number


def read_documents(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """Chunks of one snapshot: the newest, or that of commit ``number``."""
    from corpusloom.sources.commits import read_entry

    entry = read_entry(spark, f"{folder}/_commits", number) if number else newest(spark, f"{folder}/_commits")[1]
    live = _manifest(spark, entry).filter(~F.col("deleted")).select("doc_key", "part")
    # the part is a partition column, so parts without a living document are not read
    return spark.read.option("mergeSchema", True).parquet(f"{folder}/chunks").join(live, ["doc_key", "part"], "left_semi").drop("part", "doc_key")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_key, content_hash, part, deleted, version) of the newest snapshot, tombstones included."""
    return _manifest(spark, newest(spark, f"{folder}/_commits")[1])
