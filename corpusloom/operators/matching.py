"""Which of many terms occur in which texts (exact substring containment).

Every term is keyed by one of its own substrings of four characters (shorter terms by themselves): the
one found in fewest texts of a bounded sample.  Texts send only such keys; where a key is found, the
term itself is looked for.  Frequent substrings are keys of no term that has a rarer one, so they never
meet.  The sample decides which key is used, never what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialized

WIDTH = 4
#: Texts from which the frequency of keys is estimated.
SAMPLE = 500


def grams(text, width: int = WIDTH) -> Column:
    """Distinct substrings of ``width`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * width + "))"), F.lit(1)))


def keyed_terms(texts: DataFrame, names: DataFrame, width: int = WIDTH, sample: int = SAMPLE) -> DataFrame:
    """(term, gram) of the terms with at least ``width`` characters; ``texts`` has _key and _text."""
    parts = names.filter(F.length("term") >= width).select("term", F.explode(grams("term", width)).alias("gram"))
    some = texts.orderBy(F.xxhash64("_key"), F.xxhash64("_text")).limit(sample)
    seen = some.select(F.explode(grams("_text", width)).alias("gram")).groupBy("gram").agg(F.count("*").alias("_df"))
    known = parts.join(seen, "gram", "left")
    return known.groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("_df", F.lit(0)), "gram")).alias("gram"))


def contained_terms(rows: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", width: int = WIDTH, sample: int = SAMPLE) -> DataFrame:
    """(key, term): distinct non-empty terms contained in each row's text.  Rows of one key count together."""
    names = terms.select(F.col(term).cast("string").alias("term")).filter(F.coalesce("term", F.lit("")) != "").distinct()
    texts = rows.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    short = names.filter(F.length("term") < width).select("term", F.col("term").alias("gram"))
    # a row per term, written so that the optimizer knows its size
    keys = materialized(keyed_terms(texts, names, width, sample).unionByName(short))
    sizes = [r["n"] for r in keys.select(F.length("gram").alias("n")).distinct().collect()]  # at most ``width`` numbers

    def met(size: int) -> DataFrame:
        probes = texts.select("_key", F.explode(grams("_text", size)).alias("gram"))
        return probes.join(keys.filter(F.length("gram") == size), "gram").select("_key", "term").distinct()

    # short terms are found by their key alone; candidates go back to their texts once
    found = texts.limit(0).select("_key", F.lit("").alias("term"))
    for size in sizes:
        if size < width:
            found = found.unionByName(met(size))
        else:
            candidates = met(size).select(F.col("_key").alias("_owner"), "term")
            verified = texts.join(candidates, F.col("_key").eqNullSafe(F.col("_owner"))).filter(F.contains("_text", F.col("term")))
            found = found.unionByName(verified.select("_key", "term"))
    return found.distinct().select(F.col("_key").alias(key), "term")
