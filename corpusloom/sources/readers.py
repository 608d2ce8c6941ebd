"""Scans.  A missing path reads as an empty table of the given schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.search import enabled_corpora

# Office formats listed in a form catalogue.
FORM_SUFFIXES = ["xlsx", "xlsm", "xls", "docx", "doc"]


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def source_manifest(spark: SparkSession, root: str, pattern: str = "*", contents: bool = False) -> DataFrame:
    """(file, size, modified[, content_hash]) of every file below ``root`` at any depth.

    Spark lists the folders in parallel; contents are read only for their hash.
    """
    schema = "file string, size long, modified timestamp" + (", content_hash string" if contents else "")
    if not path_exists(spark, root):
        return spark.createDataFrame([], schema)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    # one scheme for both: local paths come with one slash or three
    plain, own = F.regexp_replace("path", "^file:/+", "file:/"), base.replace("file:///", "file:/")
    name = F.when(plain == own, F.regexp_extract(plain, "([^/]*)$", 1)).otherwise(F.regexp_replace(F.replace(plain, F.lit(own), F.lit("")), "^/+", ""))
    columns = [name.alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return files.select(*columns, *([F.sha2("content", 256).alias("content_hash")] if contents else []))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change) between two manifests: added, changed or removed.

    Equal hashes are no change, whatever the times; without hashes size and time decide.
    """
    hashed = "content_hash" in old.columns and "content_hash" in new.columns
    mark = (lambda t: F.struct(f"{t}.content_hash")) if hashed else (lambda t: F.struct(f"{t}.size", f"{t}.modified"))
    joined = old.alias("o").join(new.alias("n"), F.col("o.file") == F.col("n.file"), "full")
    change = F.when(F.col("o.file").isNull(), "added").when(F.col("n.file").isNull(), "removed").when(mark("o") != mark("n"), "changed")
    return joined.select(F.coalesce("o.file", "n.file").alias("file"), change.alias("change")).filter("change IS NOT NULL")


def newest_files(spark: SparkSession, derived: str, base: str, pattern: str = "*") -> DataFrame:
    """(file, path, modified): of each relative file name the derived copy, unless it is missing or older."""

    def side(root: str, order: int) -> DataFrame:
        return source_manifest(spark, root, pattern).select("file", F.concat(F.lit(root.rstrip("/") + "/"), F.col("file")).alias("path"), "modified", F.lit(order).alias("_order"))

    both = side(derived, 1).unionByName(side(base, 0))
    return both.groupBy("file").agg(F.max_by(F.struct("path", "modified"), F.struct("modified", "_order")).alias("r")).select("file", "r.*")


def newest_change(spark: SparkSession, path: str) -> int:
    """Latest modification time (ms) of a file under a path, at any depth; -1 when there is none."""
    latest = source_manifest(spark, path).agg(F.max(F.unix_millis("modified"))).first()[0]
    return -1 if latest is None else latest


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header line (a byte-order mark is ignored); quoted cells may span lines."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def read_markdown(spark: SparkSession, root: str, corpora: DataFrame) -> DataFrame:
    """(corpus_id, source_file, text) of every ``*.md`` below the folders of enabled corpora.

    ``markdown_dir`` is relative to ``root``; one scan covers all corpora and the
    folder prefix assigns the corpus.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"))
    )
    plain = F.regexp_replace(F.col("_path"), "^file:/+", "file:/")
    rel = files.withColumn("source_file", F.regexp_replace(F.replace(plain, F.lit(base.replace("file:///", "file:/")), F.lit("")), "^/+", ""))
    folders = corpora.select("corpus_id", "enabled", F.concat(F.regexp_replace("markdown_dir", "/+$", ""), F.lit("/")).alias("_dir"))
    # every folder prefix of a file is a join key, so corpora meet files by equality
    parts = F.split("source_file", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    keyed = rel.withColumn("_dir", F.explode(prefixes))
    joined = keyed.join(F.broadcast(folders), "_dir").select("corpus_id", "source_file", "text")
    return enabled_corpora(joined, corpora)


def newer_of(spark: SparkSession, derived: str, base: str) -> str:
    """The derived path unless it is missing or older than the base path."""
    a, b = newest_change(spark, derived), newest_change(spark, base)
    return derived if a >= 0 and a >= b else base


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet table; older files may lack newer columns."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """External database table."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def form_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Forms below a folder: cleaned name, file name, path and type (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(stem, r"(?U)^[0-9０-９]+[_\-　\s]*", ""), r"（.*?）|\(.*?\)", ""))
    return files.select(clean.alias("form_name"), name.alias("file_name"), F.col("path").alias("file_path"), kind.alias("file_type"), F.lit("").alias("description")).filter(
        F.col("file_type").isin(FORM_SUFFIXES)
    )
