"""Text functions: Column in, Column out, all in the JVM unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.unicode import html_unescape, html_unescape_items, nfkc, nfkc_casefold

# The white space set (Unicode White_Space plus the four ASCII separators).
# The ranges in front decide on most characters before the whole set is gone through.
SPACE = r"[\t-\x20\x85\xa0\u1680-\u3000&&[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Labels that mark working copies of headings.
WORK_LABELS = "親チャンク候補|子チャンク候補"
LOG_CUT_MARK = "...[省略]"
TOKEN_PATTERN = "([a-zA-Z0-9_]+|[\u3040-\u30ff\u3400-\u9fff])"
TERM_PATTERN = "([a-zA-Z0-9]+|[\u3040-\u30ff\u3400-\u9fff]{2,})"


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a let-expression)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(value) -> Column:
    return F.coalesce(col(value).cast("string"), F.lit(""))


def strip(value) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(col(value), F.lit(WHITESPACE_CHARS))


def squeeze(value) -> Column:
    """Collapse white space runs to one space and strip."""
    return strip(F.regexp_replace(col(value), rf"{SPACE}+", " "))


def squeeze_lines(value) -> Column:
    """:func:`squeeze` on every line of a text with ``\\n`` line ends, for all lines at once."""
    inside = F.regexp_replace(col(value), rf"[{SPACE}&&[^\n]]+", " ")
    return strip(F.regexp_replace(inside, " ?\n ?", "\n"))


def blank_to_null(value) -> Column:
    c = col(value)
    return F.when(c != "", c)


def unix_newlines(value) -> Column:
    """Every line boundary becomes ``\\n``."""
    return F.regexp_replace(col(value), r"[\x0b-\r\x1c-\x1e\x85\u2028-\u2029](?:(?<=\r)\n)?", "\n")


def lines(value) -> Column:
    return F.split(unix_newlines(value), "\n", -1)


def _drop_markup(value, strip_html_tags: bool) -> Column:
    t = F.regexp_replace(text_or_empty(value), r"(?s)<!--.*?-->", "")
    t = F.replace(F.replace(t, F.lit("<!--"), F.lit("")), F.lit("-->"), F.lit(""))
    if strip_html_tags:
        t = F.regexp_replace(t, r"(?iU)<\s*br\s*/?\s*>", "\n")
        t = F.regexp_replace(t, r"<[^>\n]+>", "")
    return t


def _tidy(value) -> Column:
    t = F.regexp_replace(col(value), rf"(?U)(^|\n)(\s*#{{1,6}}\s*)?(?:{WORK_LABELS})\s*[:：]\s*", "$1$2")
    t = F.regexp_replace(t, "[ \t]+\n", "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def clean_markup(value, strip_html_tags: bool = True, ended: bool = False) -> Column:
    """Drop comments, tags, entities (``ended``: see :func:`html_unescape`), working labels and surplus blank lines."""
    return _tidy(html_unescape(_drop_markup(value, strip_html_tags), ended))


def clean_markup_items(values, strip_html_tags: bool = True) -> Column:
    """:func:`clean_markup` on every element of a string array."""
    raw = F.transform(col(values), lambda v: _drop_markup(v, strip_html_tags))
    return F.transform(html_unescape_items(raw), _tidy)


# ---------------------------------------------------------------- tokens


def char_bigrams(value) -> Column:
    """Overlapping two-character strings in text order."""
    chars = F.split(col(value), "")
    count = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), count), F.slice(chars, F.lit(2), count), lambda a, b: F.concat(a, b))


def retrieval_tokens(value, max_bigrams: int | None = None) -> Column:
    """Words and single kana/kanji, then the character bigrams (or the first few) that are not all space."""
    low = F.lower(text_or_empty(value))
    pairs = char_bigrams(low)
    kept = F.when(
        F.rlike(low, F.lit(rf"(?U){SPACE}{{2}}")),
        F.filter(pairs, lambda p: F.length(F.btrim(p, F.lit(WHITESPACE_CHARS))) > 0),
    ).otherwise(pairs)
    words = F.regexp_extract_all(low, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.concat(words, kept if max_bigrams is None else F.slice(kept, 1, max_bigrams))


def query_terms(*values) -> Column:
    """Distinct words, kanji/kana runs of two or more, and bigrams of the compacted text."""
    low = F.lower(squeeze(F.concat_ws(" ", *[text_or_empty(v) for v in values])))
    compact = F.regexp_replace(low, rf"(?U){SPACE}+", "")
    words = F.regexp_extract_all(low, F.lit(TERM_PATTERN), F.lit(0))
    return F.array_distinct(F.filter(F.concat(words, char_bigrams(compact)), lambda t: t != ""))


def match_text(value) -> Column:
    """Lower-cased, single-spaced text for containment tests."""
    return F.lower(squeeze(text_or_empty(value)))


# ---------------------------------------------------------------- normal forms


def _question_rules(value: Column) -> Column:
    t = F.replace(value, F.lit("\u3000"), F.lit(" "))
    t = F.regexp_replace(t, "[‐-‒–—―ーｰ]+", "-")
    t = F.regexp_replace(t, r"(?U)\bno\s*\.?\s*([0-9]+)", "no$1")
    t = F.regexp_replace(t, r"(?U)タックス\s*アンサー\s*([0-9]+)", "タックスアンサー$1")
    t = F.regexp_replace(t, "[ \t\r\n]+", " ")
    t = F.regexp_replace(t, r"(?U)\s*([。、,.!?！？:：;；/／()（）［］\[\]{}<>＜＞])\s*", "$1")
    return strip(t)


def normalize_question(value) -> Column:
    """The key under which a question and its alternative wordings are matched."""
    return _question_rules(strip(nfkc_casefold(text_or_empty(value))))


def normalize_question_ascii(value) -> Column:
    """JVM-only variant for corpora known to hold no compatibility characters."""
    return _question_rules(F.lower(strip(text_or_empty(value))))


def number_references(value) -> Column:
    """Distinct article numbers (3 to 5 digits) mentioned in a text."""
    t = nfkc(text_or_empty(value))
    patterns = [r"(?iU)No\.?\s*([0-9]{3,5})", r"(?iU)タックス\s*アンサー\s*([0-9]{3,5})", r"(?iU)コード\s*([0-9]{3,5})"]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns]))


def reference_key(value) -> Column:
    """Case-folded text without punctuation or spaces, for comparing citations with titles."""
    return F.regexp_replace(
        nfkc_casefold(text_or_empty(value)),
        r"""(?U)[\s\-_/#:：,，、。．.・･「」『』【】\[\]()（）<>＜＞"'`*_]+""",
        "",
    )


# ---------------------------------------------------------------- cutting and splitting


def preview(value, limit: int = 240, mark: str = LOG_CUT_MARK) -> Column:
    t = F.replace(strip(text_or_empty(value)), F.lit("\r\n"), F.lit("\n"))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit(mark)))


def compact(value, limit: int = 400) -> Column:
    """White space collapsed, then cut."""
    return F.substring(squeeze(text_or_empty(value)), 1, limit)


def truncate(value, limit: int) -> Column:
    """Cut to ``limit`` characters and say how many were dropped; 0 keeps all."""
    t = text_or_empty(value)
    if limit <= 0:
        return t
    head = F.regexp_replace(F.substring(t, 1, limit), rf"(?U){SPACE}+\z", "")
    note = F.concat(F.lit("\n...[truncated "), (F.length(t) - limit).cast("string"), F.lit(" chars]"))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(head, note))


def split_multi(value, separators: str = "[|;,]") -> Column:
    """Trimmed non-empty parts of a multi-value cell."""
    parts = F.transform(F.split(text_or_empty(value), separators, -1), strip)
    return F.filter(parts, lambda p: p != "")


def natural_sort_key(value) -> Column:
    """Digit runs of any length led by their number of digits, so that string order equals numeric order."""
    runs = F.regexp_extract_all(text_or_empty(value), F.lit(r"(\d+|\D+)"), F.lit(0))

    def sized(r: Column) -> Column:
        digits = F.regexp_replace(r, "^0+", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(runs, lambda r: F.when(F.rlike(r, F.lit(r"^\d")), sized(r)).otherwise(r)), "")


def table_cell(value) -> Column:
    """Escape a value for a Markdown table cell."""
    t = F.replace(text_or_empty(value), F.lit("|"), F.lit("\\|"))
    return strip(F.replace(t, F.lit("\n"), F.lit(" ")))


def table_row(*values) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[table_cell(v) for v in values]), F.lit(" |"))


def search_text(title, heading, body, tags=None, extra: list | None = None) -> Column:
    """Title, heading path, text and tags joined by newlines: what gets indexed."""
    parts = [text_or_empty(title), text_or_empty(heading), text_or_empty(body)]
    parts += [text_or_empty(e) for e in extra or []]
    if tags is not None:
        parts.append(F.array_join(F.coalesce(col(tags), F.array().cast("array<string>")), " "))
    return strip(F.concat_ws("\n", *parts))


def unquote(value, quotes: str = "\"'") -> Column:
    """Strip, remove one pair of equal quotes, strip again."""

    def bare(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        quoted = (F.length(t) >= 2) & (first == F.substring(t, -1, 1)) & first.isin(*list(quotes))
        return F.when(quoted, strip(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)

    return bind(strip(text_or_empty(value)), bare)


# ---------------------------------------------------------------- headings


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, otherwise 0."""
    return F.length(F.regexp_extract(line, r"(?U)^(#{1,6})\s+\S", 1))


def heading_title(line: Column) -> Column:
    return strip(F.regexp_extract(line, r"(?U)^#{1,6}\s+(.+?)\s*$", 1))


def heading_count(value, levels: list[int]) -> Column:
    """Number of heading lines at the given levels."""
    marks = "|".join("#{%d}" % n for n in levels)
    return F.regexp_count(F.concat(F.lit("\n"), unix_newlines(value)), F.lit(rf"(?U)\n(?:{marks})[^\S\n]+\S"))
