"""Hooks for user-supplied models: batches in, batches out, errors as data.

A client is any picklable callable on a list; it runs inside Spark tasks over Arrow
batches.  Retries back off, and a batch that keeps failing marks its rows with the
error instead of failing the job.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 32


def hashing_vectors(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic offline embedding: hashed words, length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(size)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "big")
                v[h % size] += 1.0 if (h >> 32) & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def _call(client: Callable, items: list, retries: int, pause: float) -> tuple[list | None, str | None]:
    error = None
    for attempt in range(retries + 1):
        try:
            return client(items), None
        except Exception as exc:  # the error travels with the rows
            error = str(exc)
            if attempt < retries:
                time.sleep(pause * 2**attempt)
    return None, error


def _mapped(df: DataFrame, key: str, columns: list[str], client: Callable, out: str, out_type: str, arrow: pa.DataType, batch: int, retries: int, pause: float) -> DataFrame:
    key_type = dict(df.dtypes)[key]
    schema = pa.schema([(key, pa.int64() if key_type in ("bigint", "int") else pa.string()), (out, arrow), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                values = [part.column(c).to_pylist() for c in columns]
                items = values[0] if len(values) == 1 else list(zip(*values))
                result, error = _call(client, items, retries, pause)
                result = [None] * part.num_rows if result is None else result
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).cast(schema[0].type), pa.array(result, arrow), pa.array([error] * part.num_rows, pa.string())], schema=schema
                )

    return df.select(key, *columns).mapInArrow(run, f"`{key}` {'bigint' if key_type in ('bigint', 'int') else 'string'}, `{out}` {out_type}, error string")


def embed(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]], batch: int = BATCH, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """(key, embedding, error) from an embedding client."""
    return _mapped(df, key, [text], client, "embedding", "array<float>", pa.list_(pa.float32()), batch, retries, pause)


def complete(df: DataFrame, key: str, prompt: str, client: Callable[[list[str]], list[str]], batch: int = 1, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """(key, reply, error) from a text client."""
    return _mapped(df, key, [prompt], client, "reply", "string", pa.string(), batch, retries, pause)


def rerank(df: DataFrame, key: str, query: str, document: str, client: Callable[[list[tuple[str, str]]], list[float]], batch: int = BATCH, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """(key, rerank_score, error) from a (query, document) scoring client."""
    return _mapped(df, key, [query, document], client, "rerank_score", "double", pa.float64(), batch, retries, pause)
