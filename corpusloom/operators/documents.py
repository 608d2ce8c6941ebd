"""Document metadata: front matter, titles, registration and corpus settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, blank_to_null, col, strip, text_or_empty, unix_newlines
from corpusloom.functions.values import entries_to_map, slug
from corpusloom.operators.chunking import INHERITED_KEYS
from corpusloom.operators.ranking import latest

# Front matter keys written first, in this order.
PREFERRED_KEYS = [
    "title",
    "source_url",
    "document_id",
    "document_type",
    "corpus_id",
    "tax_type",
    "source_site",
    "law_basis_date",
    "original_filename",
]


def _no_entries() -> Column:
    return F.array().cast("array<struct<key:string,value:string>>")


def _split_line(line: Column, unquoted) -> Column:
    at = F.position(F.lit(":"), line)
    return F.struct(
        strip(F.substr(line, F.lit(1), at - 1)).alias("key"), unquoted(strip(F.substr(line, at + 1, F.length(line)))).alias("value")
    )


def _escaped(value: Column) -> Column:
    quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
    inner = F.substr(value, F.lit(2), F.length(value) - 2)
    return F.when(quoted, F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).otherwise(value)


def front_matter_entries(raw, dialect: str = "simple") -> Column:
    """(key, value) entries of a document's header in file order, empty without one.

    ``simple``: header up to the first line starting with ``---``; ``json``: the same
    with JSON-quoted values; ``strict``: leading HTML comment lines are skipped, the
    closing line must be exactly ``---`` and ``#`` lines are comments.
    """
    t = _header_source(raw, dialect)
    header = F.regexp_extract(t, _HEADER[dialect], 1)
    rows = F.filter(F.split(unix_newlines(header), "\n", -1), lambda r: F.contains(r, F.lit(":")))
    if dialect == "strict":
        rows = F.filter(rows, lambda r: ~F.ltrim(r).startswith("#"))
        entries = F.transform(rows, lambda r: _split_line(r, _plain_unquote))
        return F.filter(entries, lambda e: e["key"] != "")
    unquoted = _json_or_trim if dialect == "json" else _escaped
    return F.when(F.rlike(t, F.lit(_HEADER[dialect])), F.transform(rows, lambda r: _split_line(r, unquoted))).otherwise(_no_entries())


def _plain_unquote(value: Column) -> Column:
    first, last = F.substring(value, 1, 1), F.substring(value, -1, 1)
    quoted = (F.length(value) >= 2) & (first == last) & first.isin('"', "'")
    return F.when(quoted, strip(F.substr(value, F.lit(2), F.length(value) - 2))).otherwise(value)


def _json_or_trim(value: Column) -> Column:
    # a one-element array parses strings, numbers and booleans alike
    parsed = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
    return F.when((value != "") & parsed.isNotNull(), parsed).otherwise(F.btrim(value, F.lit("\"'")))


_HEADER = {
    "simple": r"(?s)\A---(.*?)\n---",
    "json": r"(?s)\A---(.*?)\n---",
    "strict": r"(?s)\A---[^\S\n]*\n(.*?)(?:(?<=\n)---[^\S\n]*(?:\n|\z))",
}


def _header_source(raw, dialect: str) -> Column:
    t = text_or_empty(raw)
    if dialect == "json":
        return F.regexp_replace(t, "\\A\ufeff+", "")
    if dialect == "strict":
        return F.regexp_replace(unix_newlines(t), r"(?U)\A(?:[^\S\n]*\n|[^\S\n]*<!--[^\n]*-->[^\S\n]*\n)+", "")
    return t


def front_matter_body(raw, dialect: str = "simple") -> Column:
    """Text after the header, or the whole text without one."""
    t = _header_source(raw, dialect)
    rest = F.regexp_replace(t, _HEADER[dialect], "")
    return F.when(F.rlike(t, F.lit(_HEADER[dialect])), F.regexp_replace(rest, rf"(?U)\A{SPACE}+", "")).otherwise(t)


def parse_front_matter(documents: DataFrame, text: str = "text", dialect: str = "simple") -> DataFrame:
    """Add ``meta`` (last of equal keys wins) and replace the text by the body."""
    return documents.withColumn("_entries", front_matter_entries(text, dialect)).withColumn("meta", entries_to_map(F.col("_entries"))).withColumn(
        text, front_matter_body(text, dialect)
    ).drop("_entries")


def quoted(value) -> Column:
    v = F.replace(F.replace(text_or_empty(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), v, F.lit('"'))


def render_front_matter(meta, body, preferred: list[str] = PREFERRED_KEYS) -> Column:
    """Header with the preferred keys first, the others in map order, then the body."""
    entries = F.map_entries(col(meta))
    known = F.array_compact(F.array(*[F.when(F.map_contains_key(col(meta), k), F.struct(F.lit(k).alias("key"), col(meta)[k].alias("value"))) for k in preferred]))
    rest = F.filter(entries, lambda e: ~e["key"].isin(preferred))
    rows = F.transform(F.concat(known, rest), lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"])))
    head = F.concat_ws("\n", F.lit("---"), F.array_join(rows, "\n"), F.lit("---"))
    return F.concat(head, F.lit("\n\n"), F.regexp_replace(text_or_empty(body), rf"(?U)\A{SPACE}+", ""))


def document_title(text, meta=None, fallback=None) -> Column:
    """Metadata title, else the first H1, else the fallback."""
    first = strip(F.regexp_extract(F.concat(F.lit("\n"), unix_newlines(text)), r"(?U)\n#[^\S\n]+(\S[^\n]*)", 1))
    own = blank_to_null(col(meta)["title"]) if meta is not None else F.lit(None).cast("string")
    return F.coalesce(own, blank_to_null(first), text_or_empty(fallback) if fallback is not None else F.lit(""))


def file_stem(path) -> Column:
    return F.regexp_replace(F.regexp_extract(col(path), "([^/]*)$", 1), r"\.[^.]*$", "")


def inherited_columns(meta, keys: list[str] = INHERITED_KEYS) -> list[Column]:
    """One nullable column per inherited metadata key; empty values are NULL."""
    return [blank_to_null(col(meta)[k]).alias(k) for k in keys]


def iso_date_error(value, name: str) -> Column:
    raw = strip(text_or_empty(value))
    return F.when((raw != "") & F.try_to_date(raw, "yyyy-MM-dd").isNull(), F.lit(f"{name} must be YYYY-MM-DD"))


def register_documents(payloads: DataFrame) -> DataFrame:
    """File name, metadata defaults and an ``errors`` array for submitted documents.

    Accepted rows have an empty array; the others are the quarantine.
    """
    body = front_matter_body(F.regexp_replace(text_or_empty("markdown_text"), "\\A\ufeff+", ""))
    seed = F.coalesce(blank_to_null("filename"), blank_to_null(strip(text_or_empty("document_id"))), blank_to_null(strip(text_or_empty("title"))), F.lit("document"))
    name = slug(file_stem(seed), "document")
    start, end = strip(text_or_empty("valid_from")), strip(text_or_empty("valid_until"))
    errors = F.array_compact(
        F.array(
            F.when(strip(text_or_empty("corpus_id")) == "", F.lit("corpus_id is required")),
            F.when(strip(body) == "", F.lit("markdown_text is required")),
            iso_date_error("valid_from", "valid_from"),
            iso_date_error("valid_until", "valid_until"),
            F.when(
                F.try_to_date(start, "yyyy-MM-dd") > F.try_to_date(end, "yyyy-MM-dd"),
                F.lit("valid_from must be before or equal to valid_until"),
            ),
        )
    )
    return payloads.select(
        "corpus_id",
        F.concat(name, F.lit(".md")).alias("filename"),
        F.coalesce(blank_to_null(strip(text_or_empty("title"))), seed).alias("title"),
        F.coalesce(blank_to_null(strip(text_or_empty("document_type"))), F.lit("manual")).alias("document_type"),
        F.coalesce(blank_to_null(strip(text_or_empty("document_id"))), name).alias("document_id"),
        start.alias("valid_from"),
        end.alias("valid_until"),
        F.coalesce(blank_to_null(strip(text_or_empty("registered_by"))), F.lit("admin")).alias("registered_by"),
        F.regexp_replace(body, rf"(?U){SPACE}+\z", "").alias("text"),
        errors.alias("errors"),
    )


def upsert_corpora(corpora: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge corpus settings by id; absent values keep the old one, else the default."""
    last = latest(changes, ["corpus_id"], [F.col("change_no").desc()]).drop("change_no") if "change_no" in changes.columns else changes
    old, new = corpora.alias("o"), last.alias("n")
    joined = old.join(new, "corpus_id", "full")
    folder = F.concat(F.lit("data/markdown/"), slug("corpus_id", "corpus"))

    def pick(name: str, default: Column) -> Column:
        return F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}"), default).alias(name)

    def pick_text(name: str, default: Column) -> Column:
        return strip(F.coalesce(blank_to_null(F.col(f"n.{name}")), blank_to_null(F.col(f"o.{name}")), default)).alias(name)

    return joined.select(
        "corpus_id", pick_text("markdown_dir", folder), pick_text("display_name", F.col("corpus_id")), pick_text("description", F.lit("")),
        pick("enabled", F.lit(True)), pick("priority", F.lit(100)),
    )


