"""Helpers shared by the operators: tables in the shared folder, input columns, batches of rows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local master without the setting gets a temporary folder; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps: it does so when the driver's JVM collects its garbage, else late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing reads any more, and shuffle files of finished steps."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)
    collected(df.sparkSession)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string (null becomes empty); every other column but ``more`` is left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *(F.col(c) for c in more),
    )


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in ``docs``; one column is read."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def release() -> None:
    """Give freed memory of this worker back to the system; called when a task has read its input."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as make it no column of ``df`` (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def groups(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Record batches put together until ``column`` holds ``limit`` bytes; long ones are cut between rows."""
    held, size = [], 0
    for batch in batches:
        start, n = 0, batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        base = 0
        while start < n:
            stop = int(np.searchsorted(ends, base + limit - size, side="left")) + 1
            stop = min(max(stop, start + 1), n)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - base
            base, start = int(ends[stop - 1]), stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, which compress well when neighbours are alike."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def batch_of(schema: T.StructType, columns: dict) -> pa.RecordBatch:
    """A record batch in the order and with the types of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)


def in_batches(schema: T.StructType, columns: dict, rows: int = 20000) -> Iterator[pa.RecordBatch]:
    """Like ``batch_of``, in batches of at most ``rows`` rows."""
    n = len(next(iter(columns.values())))
    for i in range(0, n, rows):
        yield batch_of(schema, {k: v[i : i + rows] for k, v in columns.items()})


def rewritten(docs: DataFrame, change, extra: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns ``extra``, its texts passed through ``change``.

    ``change`` gets the texts (null as the empty text) and the rows, and returns a text for each, or None
    to drop the row.  A null text that comes back empty stays null.  ``n_chars`` follows the text.
    """
    schema = docs.drop(*extra).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 1 << 22):
            texts = part.column("text").to_pylist()
            new = change([t or "" for t in texts], part)
            kept = [i for i, t in enumerate(new) if t is not None]
            new = [None if texts[i] is None and not new[i] else new[i] for i in kept]
            part = part.take(pa.array(kept, pa.int64())).select(schema.names)
            for name, values in (("text", new), ("n_chars", [None if t is None else len(t) for t in new])):
                if name in schema.names:
                    at = schema.names.index(name)
                    part = part.set_column(at, part.schema.field(at), pa.array(values, part.schema.field(at).type))
            yield from part.combine_chunks().to_batches()
        release()

    return docs.mapInArrow(apply, schema)
