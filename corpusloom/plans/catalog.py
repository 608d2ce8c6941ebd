"""Registry of queries and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# tables whose rows are expensive to process
WIDE = {"documents", "pages"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table.  Scans with fewer tasks than cores (small single files) are spread out first.

    Larger tables of pages are dealt evenly over four tasks a core, so that no task has a whole
    split of the files: chunking costs far more than the shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in WIDE:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
        if name == "pages":
            return df.repartition(4 * df.rdd.getNumPartitions())
    return df


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """Folder of a table or index derived from the tables of ``sf_dir``.

    ``build`` writes it, once per application, to the shared folder; every query that asks
    for it later reads what is there.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build(folder)
        _STORED[key] = folder
    return _STORED[key]


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, floats as double, dates and times as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL, if there is one."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# ---------------------------------------------------------------- SQL fragments


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def id_sql(*parts: str) -> str:
    return "substr(sha1(" + " || '||' || ".join(parts) + "), 1, 16)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts if p) + "\n"
