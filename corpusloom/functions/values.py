"""Ids, safe coercions and small lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import bind, col, strip, text_or_empty, unquote
from corpusloom.functions.unicode import nfkc

# Words that mean "nothing recorded".
BLANK_WORDS = ["", '""', "''", "なし", "無し", "不明", "明記なし", "取得できない"]
TRUE_WORDS = ["1", "true", "yes", "on"]


def each(df: DataFrame, items, *keep, item: str = "_s", pos: str = "_pos") -> DataFrame:
    """One row per array element with its 0-based position.

    The outer form is used, with the empty case removed afterwards, because the inner
    form makes the optimizer test the array in a filter and so compute it twice.
    """
    out = df.select(*keep, F.posexplode_outer(items).alias(pos, item))
    return out.filter(F.col(pos).isNotNull())


def content_id(*parts, length: int = 16) -> Column:
    """First hex digits of the SHA-1 of the parts joined by two pipes."""
    return F.substring(F.sha1(F.concat_ws("||", *[text_or_empty(p) for p in parts])), 1, length)


def slug(value, fallback: str = "document", max_chars: int = 80) -> Column:
    """Lower-case identifier of letters, digits, dot, dash and underscore."""
    raw = text_or_empty(value)
    t = F.regexp_replace(F.lower(strip(raw)), "[^a-z0-9._-]+", "_")
    t = F.btrim(F.regexp_replace(t, "_+", "_"), F.lit("._-"))
    digest = F.substring(F.sha1(F.when(raw == "", F.lit(fallback)).otherwise(raw)), 1, 10)
    named = F.when(t == "", F.concat(F.lit(fallback + "_"), digest)).otherwise(t)
    cut = F.btrim(F.substring(named, 1, max_chars), F.lit("._-"))
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def file_id(value) -> Column:
    """NFKC, lower case, path separators and other signs to single underscores."""
    t = F.translate(F.lower(nfkc(text_or_empty(value))), "/\\", "__")
    t = F.regexp_replace(F.regexp_replace(t, r"[^0-9a-zA-Z_\-.]+", "_"), "_+", "_")
    return F.btrim(t, F.lit("._-"))


def release_slug(value) -> Column:
    """Letters, digits and single underscores."""
    t = F.regexp_replace(strip(text_or_empty(value)), "[^a-zA-Z0-9_]+", "_")
    return F.btrim(F.regexp_replace(t, "_+", "_"), F.lit("_"))


def name_uuid(value, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based (version 5) UUID of a string."""
    digest = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(text_or_empty(value), "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (nibble % 4) + 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def safe_int(value, default: int = 0, floor: int | None = None) -> Column:
    """Integer or the default; never below ``floor``."""
    parsed = F.coalesce(strip(text_or_empty(value)).try_cast("int"), F.lit(default))
    return parsed if floor is None else F.greatest(parsed, F.lit(floor))


def safe_float(value, default: float | None = 0.0) -> Column:
    parsed = strip(text_or_empty(value)).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def safe_bool(value) -> Column:
    return F.lower(strip(text_or_empty(value))).isin(TRUE_WORDS)


def ratio(numerator, denominator, digits: int = 4) -> Column:
    """Rounded quotient, 0 when the denominator is 0."""
    share = F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))
    return F.coalesce(F.round(share, digits), F.lit(0.0))


def null_if_blank(value) -> Column:
    """NULL for blank words, otherwise the unquoted value."""
    return bind(unquote(value), lambda t: F.when(~t.isin(BLANK_WORDS), t))


def is_blank(value) -> Column:
    return unquote(value).isin(BLANK_WORDS)


def entry_value(entries: Column, key: str) -> Column:
    """Value of the last ``key`` in an array of (key, value) structs."""
    hits = F.filter(entries, lambda e: e["key"] == key)
    return F.try_element_at(hits, F.lit(-1))["value"]


def entries_to_map(entries: Column) -> Column:
    """Map of an entry array in which the last of equal keys wins."""
    kept = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(kept)


def json_strings(value) -> Column:
    """JSON text to ``array<string>``; anything unreadable is an empty array."""
    return F.coalesce(F.from_json(text_or_empty(value), "array<string>"), F.array().cast("array<string>"))


def fenced_json(value) -> Column:
    """Text with a surrounding Markdown code fence removed."""
    t = strip(text_or_empty(value))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)^```(?:json)?\s*", ""), r"(?U)\s*```$", "")
    return strip(t)


def positive(n: int) -> int:
    """``n``, which must be 1 or more: callers' numbers are obeyed or refused, never changed."""
    if n < 1:
        raise ValueError(f"{n} is less than 1")
    return n
