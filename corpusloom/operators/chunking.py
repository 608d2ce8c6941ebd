"""Documents to parent sections to child passages.

All splitting is row-local: a document's lines, sections and passages live in
arrays built by higher-order functions, so chunking a corpus needs no shuffle
and a very long document only affects the row that holds it.  The sequential
rules (greedy packing, merging) are folds over arrays of paragraphs or sections, linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import (
    WHITESPACE_CHARS,
    clean_markup,
    clean_markup_items,
    col,
    heading_level,
    heading_title,
    strip,
    text_or_empty,
    unix_newlines,
    unquote,
)
from corpusloom.functions.values import bind, content_id, each, entry_value, safe_bool, safe_int

# Chunking defaults.
DEFAULTS = {
    "parent_split_levels": [2],
    "max_parent_chars": 12000,
    "min_parent_chars": 0,
    "child_max_chars": 900,
    "child_overlap_chars": 120,
    "force_heading_split": False,
    "auto_descend": False,
    "chunking_mode": "auto",
}
TEMPLATE_PARENT_CHARS = 20000
TEMPLATE_CHILD_CHARS = 1200
TEMPLATE_OVERLAP = 150
MODES = ["auto", "heading", "html_comment"]
# Front-matter keys that chunks inherit.
INHERITED_KEYS = [
    "taxanswer_no",
    "document_type",
    "document_id",
    "tsutatsu_name",
    "tax_type",
    "category",
    "asset_tax_category",
    "source_url",
    "source_site",
    "pdf_path",
    "law_basis_date",
    "valid_from",
    "valid_until",
]

SECTION = "array<struct<heading_path:string,text:string>>"
_NEW_HEADING = r"(?=#)(?<=\n)(?=#{1,6}[^\S\n]+\S)"
# most characters are passed by the first test
_NEW_BLOCK = r"(?U)(?=[\n#])(?:\n(?:[^\S\n]*\n)+|" + _NEW_HEADING + ")"
_TITLES = [f"t{n}" for n in range(1, 7)]


def _int(value) -> Column:
    return F.lit(value) if isinstance(value, int) else col(value).cast("int")


def _section(path: Column, text: Column) -> Column:
    return F.struct(path.alias("heading_path"), text.alias("text"))


def _no_sections() -> Column:
    return F.array().cast(SECTION)


#: Items of one inner fold.
FOLD_RUN = 512


def _fold(items: Column, names: list[str], first: Column, step, finish) -> Column:
    """``F.aggregate`` for a state of ``names`` and a growing array ``out``, linear in the items.

    Every step that extends an array copies it.  So the items are folded run by run, each run into an
    array of its own, and the runs are put together once at the end.
    """

    def state(s: Column, out: Column, name: str = "out") -> Column:
        return F.struct(*[s[n].alias(n) for n in names], out.alias(name))

    def run(s: Column, part: Column) -> Column:
        folded = F.aggregate(part, state(s, first["out"]), step)
        return bind(folded, lambda r: state(r, F.concat(s["outs"], F.array(r["out"])), "outs"))

    def over(all_items: Column) -> Column:
        last = F.floor(F.greatest(F.size(all_items) - 1, F.lit(0)) / FOLD_RUN).cast("int")
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_items, i * FOLD_RUN + 1, F.lit(FOLD_RUN)))
        return F.aggregate(runs, state(first, F.array(first["out"]), "outs"), run, lambda s: finish(state(s, F.flatten(s["outs"]))))

    return bind(items, over)


# ---------------------------------------------------------------- heading stack


def _push_heading(state: Column, level: Column, title: Column) -> list[Column]:
    """The six open titles after a heading: deeper ones close, this one opens."""
    return [
        F.when(level == n, title).when(level > n, state[f"t{n}"]).alias(f"t{n}") for n in range(1, 7)
    ]


def _keep_headings(state: Column) -> list[Column]:
    return [state[t].alias(t) for t in _TITLES]


def _no_headings() -> list[Column]:
    return [F.lit(None).cast("string").alias(t) for t in _TITLES]


def _path(titles: list[Column]) -> Column:
    return F.concat_ws(" > ", *titles)


def _led(parts: Column, max_level: int = 6) -> Column:
    """Parts with the level and title of a heading in their first line (level 0: none).

    They are read once here; in the steps of a fold every mention would be evaluated again.
    """

    def led(part: Column, level: Column, title: Column) -> Column:
        return F.struct(part.alias("text"), level.alias("level"), title.alias("title"))

    def read(part: Column, line: Column) -> Column:
        return bind(
            heading_level(line),
            lambda n: F.when(n.between(1, max_level), led(part, n, heading_title(line))).otherwise(led(part, F.lit(0), F.lit(None).cast("string"))),
        )

    def one(part: Column) -> Column:
        first = bind(F.split_part(part, F.lit("\n"), F.lit(1)), lambda line: read(part, line))
        return F.when(part.startswith("#"), first).otherwise(led(part, F.lit(0), F.lit(None).cast("string")))

    return F.transform(parts, one)


def _moved(state: Column, part: Column) -> list[Column]:
    """The open titles after a part of :func:`_led`; one without a heading leaves them."""
    level, title = part["level"], part["title"]
    return [F.when(level == n, title).when((level == 0) | (level > n), state[f"t{n}"]).alias(f"t{n}") for n in range(1, 7)]


# ---------------------------------------------------------------- heading sections


def _unix(text, clean: bool) -> Column:
    return col(text) if clean else unix_newlines(text)


def heading_sections(text, base_path, levels, clean: bool = False) -> Column:
    """Split at headings of the given levels.

    Lines before the first such heading, and every heading above the smallest
    target level, form a prefix repeated in front of the sections they cover.
    ``levels`` is a list of ints or an ``array<int>`` column.  ``clean`` (also below): the
    text is known to have no line ends but ``\\n``.
    """
    wanted = F.array(*[F.lit(n) for n in levels]) if isinstance(levels, list) else col(levels)
    base = col(base_path)
    # piece 0 is what precedes the first heading, piece i starts with heading i
    source = F.concat(F.lit("\n"), _unix(text, clean))

    def from_pieces(pieces: Column) -> Column:
        heads = F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces)),
            lambda p, i: F.struct(
                (i + 1).alias("at"), heading_level(p).alias("level"), heading_title(F.split_part(p, F.lit("\n"), F.lit(1))).alias("title")
            ),
        )
        runs = "array<struct<pre_from:int,pre_to:int,start:int,stop:int,path:string>>"
        first = F.struct(
            *_no_headings(),
            F.lit(False).alias("open"),
            F.lit(0).alias("pre_from"),
            F.lit(0).alias("pre_to"),
            F.lit(0).alias("start"),
            F.lit("").alias("path"),
            F.array().cast(runs).alias("out"),
        )

        def closed(s: Column, stop: Column) -> Column:
            run = F.struct(
                s["pre_from"].alias("pre_from"), s["pre_to"].alias("pre_to"), s["start"].alias("start"),
                stop.alias("stop"), s["path"].alias("path"),
            )
            return F.when(s["open"], F.concat(s["out"], F.array(run))).otherwise(s["out"])

        def step(s: Column, h: Column) -> Column:
            titles = _push_heading(s, h["level"], h["title"])
            above = h["level"] < F.array_min(wanted)
            target = F.array_contains(wanted, h["level"])
            below_top = _path(titles[1:])
            path = F.when(below_top == "", base).otherwise(F.concat(base, F.lit(" > "), below_top))
            return F.struct(
                *titles,
                F.when(above, F.lit(False)).when(target, F.lit(True)).otherwise(s["open"]).alias("open"),
                F.when(above & s["open"], h["at"]).otherwise(s["pre_from"]).alias("pre_from"),
                F.when(target & ~s["open"], h["at"]).otherwise(s["pre_to"]).alias("pre_to"),
                F.when(target, h["at"]).otherwise(s["start"]).alias("start"),
                F.when(target, path).otherwise(s["path"]).alias("path"),
                F.when(above | target, closed(s, h["at"])).otherwise(s["out"]).alias("out"),
            )

        def joined(start: Column, stop: Column) -> Column:
            return F.array_join(F.slice(pieces, start + 1, stop - start), "")

        def finish(s: Column) -> Column:
            cut = F.transform(
                closed(s, F.size(pieces)),
                lambda r: _section(
                    r["path"],
                    strip(F.concat(joined(r["pre_from"], r["pre_to"]), F.lit("\n"), joined(r["start"], r["stop"]))),
                ),
            )
            whole = strip(F.array_join(pieces, ""))
            rest = F.when(~s["open"] & (whole != ""), F.array(_section(base, whole))).otherwise(_no_sections())
            return F.concat(cut, rest)

        return _fold(heads, [*_TITLES, "open", "pre_from", "pre_to", "start", "path"], first, step, finish)

    return bind(F.split(source, "(?U)" + _NEW_HEADING, -1), from_pieces)


def template_sections(text, max_chars: int = TEMPLATE_PARENT_CHARS) -> Column:
    """Split at every heading of level 1-3 with the full path; heading-only sections
    are dropped and oversize ones re-split by paragraph."""
    source = F.concat(F.lit("\n"), unix_newlines(text))
    pieces = F.split(source, r"(?U)(?<=\n)(?=#{1,3}[^\S\n]+\S)", -1)
    first = F.struct(*_no_headings(), F.array().cast(SECTION).alias("out"))

    def step(s: Column, piece: Column) -> Column:
        body, titles = piece["text"], _moved(s, piece)
        has_content = F.rlike(F.regexp_replace(body, r"(?Um)^#{1,6}[^\S\n]+\S.*$", ""), F.lit(r"\S"))
        kept = F.concat(s["out"], F.array(_section(_path(titles), body)))
        return F.struct(*titles, F.when(has_content, kept).otherwise(s["out"]).alias("out"))

    sections = _fold(_led(F.transform(pieces, strip), 3), _TITLES, first, step, lambda s: s["out"])
    whole = strip(unix_newlines(text))
    none_found = F.when(whole != "", F.array(_section(F.lit(""), whole))).otherwise(_no_sections())

    def resplit(section: Column) -> Column:
        start = F.struct(
            F.array().cast("array<string>").alias("buf"), F.lit(0).alias("size"), F.lit(1).alias("part"),
            _no_sections().alias("out"),
        )

        def pack(s: Column, p: Column) -> Column:
            full = (F.size(s["buf"]) > 0) & (s["size"] + F.length(p) > max_chars)
            label = F.concat(section["heading_path"], F.lit(" / part"), s["part"].cast("string"))
            done = F.concat(s["out"], F.array(_section(label, strip(F.array_join(s["buf"], "\n\n")))))
            return F.struct(
                F.when(full, F.array(p)).otherwise(F.concat(s["buf"], F.array(p))).alias("buf"),
                F.when(full, F.length(p)).otherwise(s["size"] + F.length(p)).alias("size"),
                F.when(full, s["part"] + 1).otherwise(s["part"]).alias("part"),
                F.when(full, done).otherwise(s["out"]).alias("out"),
            )

        def last(s: Column) -> Column:
            label = F.when(
                s["part"] > 1, F.concat(section["heading_path"], F.lit(" / part"), s["part"].cast("string"))
            ).otherwise(section["heading_path"])
            return F.concat(s["out"], F.array(_section(label, strip(F.array_join(s["buf"], "\n\n")))))

        parts = _fold(F.split(section["text"], "\n{2,}", -1), ["buf", "size", "part"], start, pack, last)
        return F.when(F.length(section["text"]) <= max_chars, F.array(section)).otherwise(parts)

    found = bind(sections, lambda s: F.when(F.size(s) > 0, s).otherwise(none_found))
    return F.flatten(F.transform(found, resplit))


# ---------------------------------------------------------------- windows and packing


def windows(text, max_chars, overlap) -> Column:
    """Fixed-size windows; each starts ``overlap`` characters before the previous end.

    Linear in the text: it is cut once into stride-long pieces and every window
    is put together from the pieces it covers.
    """
    size, back = _int(max_chars), _int(overlap)
    if isinstance(max_chars, int) and isinstance(overlap, int) and overlap >= max_chars:
        raise ValueError("overlap must be smaller than the window")
    t = text_or_empty(text)
    bad = F.raise_error(F.lit("overlap must be smaller than the window")).cast("int")
    stride = size - back if isinstance(max_chars, int) and isinstance(overlap, int) else F.when(back < size, size - back).otherwise(bad)
    pattern = F.concat(F.lit("(?s).{1,"), stride.cast("string"), F.lit("}"))
    span = F.ceil(size / stride).cast("int")
    # windows start at 0, stride, 2*stride ... while more than the overlap is left
    last = F.floor(F.greatest(F.length(t) - back - 1, F.lit(0)) / stride).cast("int")

    def cut(pieces: Column) -> Column:
        starts = F.sequence(F.lit(0), F.least(last, F.greatest(F.size(pieces) - 1, F.lit(0))))
        return F.transform(starts, lambda i: F.substr(F.array_join(F.slice(pieces, i + 1, span), ""), F.lit(1), size))

    trimmed = F.transform(bind(F.regexp_extract_all(t, pattern, F.lit(0)), cut), strip)
    return F.filter(trimmed, lambda w: w != "")


def pack_paragraphs(text, heading_path, max_chars, overlap) -> Column:
    """Pack blank-line paragraphs greedily up to ``max_chars``; longer ones become windows.

    Parts after the first are labelled ``/ partN``; windows always are.
    """
    t, path, size = text_or_empty(text), col(heading_path), _int(max_chars)
    paragraphs = F.filter(F.transform(F.split(t, "\n{2,}", -1), strip), lambda p: p != "")
    first = F.struct(F.lit("").alias("buf"), F.lit(1).alias("part"), _no_sections().alias("out"))

    def label(part: Column) -> Column:
        return F.concat(path, F.lit(" / part"), part.cast("string"))

    def flushed(s: Column) -> Column:
        named = F.when(s["part"] > 1, label(s["part"])).otherwise(path)
        return F.concat(s["out"], F.array(_section(named, s["buf"])))

    def step(s: Column, p: Column) -> Column:
        full = (s["buf"] != "") & (F.length(s["buf"]) + F.length(p) + 2 > size)
        fits = F.length(p) <= size
        part = F.when(full, s["part"] + 1).otherwise(s["part"])
        out = F.when(full, flushed(s)).otherwise(s["out"])
        cut = F.when(fits, F.array().cast("array<string>")).otherwise(windows(p, max_chars, overlap))
        return bind(
            F.struct(part.alias("part"), out.alias("out"), cut.alias("cut")),
            lambda n: F.struct(
                F.when(~fits, F.lit(""))
                .when(full | (s["buf"] == ""), p)
                .otherwise(F.concat(s["buf"], F.lit("\n\n"), p))
                .alias("buf"),
                (n["part"] + F.size(n["cut"])).alias("part"),
                F.concat(n["out"], F.transform(n["cut"], lambda w, i: _section(label(n["part"] + i), w))).alias("out"),
            ),
        )

    packed = _fold(paragraphs, ["buf", "part"], first, step, lambda s: F.when(s["buf"] != "", flushed(s)).otherwise(s["out"]))
    return F.when(F.length(t) <= size, F.array(_section(path, t))).otherwise(packed)


def merge_small(sections, min_chars, max_chars) -> Column:
    """Append a section to a predecessor shorter than ``min_chars`` while the pair fits."""
    rows, low, high = col(sections), _int(min_chars), _int(max_chars)
    first = F.struct(
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"), _no_sections().alias("out")
    )

    def step(s: Column, r: Column) -> Column:
        pair = F.concat(F.rtrim(s["text"], F.lit(WHITESPACE_CHARS)), F.lit("\n\n"), strip(r["text"]))
        empty = s["text"].isNull()
        # null: the two stay apart
        joined = bind(F.when(~empty & (F.length(s["text"]) < low), pair), lambda p: F.when(F.length(p) <= high, p))
        return bind(
            joined,
            lambda p: F.struct(
                F.when(p.isNotNull(), F.concat(s["path"], F.lit(" + "), r["heading_path"])).otherwise(r["heading_path"]).alias("path"),
                F.coalesce(p, r["text"]).alias("text"),
                F.when(empty | p.isNotNull(), s["out"])
                .otherwise(F.concat(s["out"], F.array(_section(s["path"], s["text"]))))
                .alias("out"),
            ),
        )

    merged = _fold(rows, ["path", "text"], first, step, lambda s: F.concat(s["out"], F.array(_section(s["path"], s["text"]))))
    return F.when((low <= 0) | (F.size(rows) <= 1), rows).otherwise(merged)


def blocks(text, default_path, clean: bool = False) -> Column:
    """Runs of non-blank lines; a heading line starts a block and moves the heading path."""
    base = col(default_path)
    source = F.concat(F.lit("\n"), _unix(text, clean))
    parts = F.transform(F.split(source, _NEW_BLOCK, -1), strip)
    first = F.struct(*_no_headings(), base.alias("path"), _no_sections().alias("out"))

    def step(s: Column, part: Column) -> Column:
        titles = _moved(s, part)
        moved = bind(_path(titles), lambda p: F.when(p == "", base).otherwise(p))
        path = F.when(part["level"] == 0, s["path"]).otherwise(moved)
        return F.struct(*titles, path.alias("path"), F.concat(s["out"], F.array(_section(path, part["text"]))).alias("out"))

    return _fold(_led(F.filter(parts, lambda p: p != "")), [*_TITLES, "path"], first, step, lambda s: s["out"])


def child_chunks(text, heading_path, max_chars, overlap, clean: bool = False) -> Column:
    """Pack blocks greedily into passages; a passage takes the path of its first block."""
    size = _int(max_chars)
    # chars: the length of buf
    first = F.struct(F.lit("").alias("buf"), F.lit(0).alias("chars"), F.lit("").alias("path"), _no_sections().alias("out"))

    def flushed(s: Column) -> Column:
        return F.concat(s["out"], F.array(_section(s["path"], s["buf"])))

    def step(s: Column, b: Column) -> Column:
        full = (s["chars"] > 0) & (s["chars"] + b["chars"] + 2 > size)
        fits = b["chars"] <= size
        fresh = full | (s["chars"] == 0)
        done = F.when(full, flushed(s)).otherwise(s["out"])
        cut = F.transform(windows(b["text"], max_chars, overlap), lambda w: _section(b["heading_path"], w))
        return F.struct(
            F.when(~fits, F.lit("")).when(fresh, b["text"]).otherwise(F.concat(s["buf"], F.lit("\n\n"), b["text"])).alias("buf"),
            F.when(~fits, F.lit(0)).when(fresh, b["chars"]).otherwise(s["chars"] + 2 + b["chars"]).alias("chars"),
            F.when(fresh, b["heading_path"]).otherwise(s["path"]).alias("path"),
            F.when(fits, done).otherwise(F.concat(done, cut)).alias("out"),
        )

    measured = F.transform(blocks(text, heading_path, clean), lambda b: F.struct(b["heading_path"], b["text"], F.length(b["text"]).alias("chars")))
    return _fold(measured, ["buf", "chars", "path"], first, step, lambda s: F.when(s["buf"] != "", flushed(s)).otherwise(s["out"]))


def template_child_chunks(
    text, max_chars: int = TEMPLATE_CHILD_CHARS, overlap: int = TEMPLATE_OVERLAP, legacy: bool = True
) -> Column:
    """Passages cut before headings, articles and numbered items.

    ``legacy`` keeps the final fragment that lies wholly inside the previous window.
    """
    if overlap >= max_chars:
        raise ValueError("overlap must be smaller than the window")
    marks = r"(?U)(?=\n#{1,6}\s+|\n第[0-9一二三四五六七八九十百]+条|\n\([0-9一二三四五六七八九十]+\))"
    parts = F.filter(F.transform(F.split(F.concat(F.lit("\n"), text_or_empty(text)), marks, -1), strip), lambda p: p != "")
    first = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))
    stride = max_chars - overlap

    def raw_windows(p: Column) -> Column:
        stop = F.length(p) - 1 if legacy else F.greatest(F.length(p) - overlap - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), stop, F.lit(stride)), lambda i: F.substr(p, i + 1, F.lit(max_chars))
        )

    def step(s: Column, p: Column) -> Column:
        joins = F.length(s["buf"]) + F.length(p) + 2 <= max_chars
        done = F.when(s["buf"] != "", F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])
        fits = F.length(p) <= max_chars
        return F.struct(
            F.when(joins, strip(F.concat(s["buf"], F.lit("\n\n"), p))).when(fits, p).otherwise(F.lit("")).alias("buf"),
            F.when(joins, s["out"]).when(fits, done).otherwise(F.concat(done, raw_windows(p))).alias("out"),
        )

    return _fold(parts, ["buf"], first, step, lambda s: F.when(s["buf"] != "", F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"]))


# ---------------------------------------------------------------- parents


def parent_sections(text, title, rules, clean: bool = False) -> Column:
    """Whole text, or heading sections when forced or too long; oversize sections descend
    one heading level at a time where allowed, then fall back to paragraph packing."""
    t, c = text_or_empty(text), col(rules)
    limit = c["max_parent_chars"]
    split_now = c["force_heading_split"] | (F.length(t) > limit)
    sections = F.when(split_now, heading_sections(t, title, c["parent_split_levels"], clean)).otherwise(
        F.array(_section(col(title), strip(t)))
    )
    deepest = F.array_max(c["parent_split_levels"])

    def descend(section: Column, level: Column) -> Column:
        nested = bind(
            heading_sections(section["text"], section["heading_path"], F.array(level), clean),
            lambda n: F.when(F.size(n) > 1, n).otherwise(F.array(section)),
        )
        due = c["auto_descend"] & (level > deepest) & (F.length(section["text"]) > limit)
        return F.when(due, nested).otherwise(F.array(section))

    # one pass per heading level below the configured ones
    sections = F.aggregate(
        F.sequence(F.lit(2), F.lit(6)), sections, lambda acc, level: F.flatten(F.transform(acc, lambda s: descend(s, level)))
    )
    packed = F.flatten(
        F.transform(
            sections,
            lambda s: F.when(F.length(s["text"]) <= limit, F.array(s)).otherwise(
                pack_paragraphs(s["text"], s["heading_path"], limit, c["child_overlap_chars"])
            ),
        )
    )
    return bind(packed, lambda s: merge_small(s, c["min_parent_chars"], limit))


# ---------------------------------------------------------------- marker comments

_MARKER_AHEAD = (
    r"(?isU)(?=<!--(?:(?!-->).)*?\b(?:parent_chunk|child_chunk)\b\s*[:：]\s*(?!-->)[^|\s])"
)


def chunk_markers(text) -> Column:
    """Marker comments in order: kind, id, attributes and the raw text up to the next marker."""
    pieces = F.split(F.concat(F.lit("\n"), text_or_empty(text)), _MARKER_AHEAD, -1)

    def parse(piece: Column) -> Column:
        body = strip(F.regexp_extract(piece, r"(?s)^<!--(.*?)-->", 1))
        kind = F.regexp_extract(body, r"(?iU)\b(parent_chunk|child_chunk)\b\s*[:：]\s*[^|]+", 1)
        marker = F.regexp_extract(body, r"(?iU)\b(?:parent_chunk|child_chunk)\b\s*[:：]\s*([^|]+)", 1)
        fields = F.filter(
            F.transform(F.split(body, r"\|", -1), strip), lambda f: F.rlike(f, F.lit(r"(?U)^[A-Za-z_][A-Za-z0-9_]*\s*[:：]"))
        )
        attrs = F.transform(
            fields,
            lambda f: F.struct(
                F.lower(F.regexp_extract(f, "^([A-Za-z_][A-Za-z0-9_]*)", 1)).alias("key"),
                unquote(F.regexp_extract(f, r"(?U)^[A-Za-z_][A-Za-z0-9_]*\s*[:：]\s*(.*)", 1)).alias("value"),
            ),
        )
        return F.struct(
            F.lower(kind).alias("kind"), unquote(marker).alias("marker_id"), attrs.alias("attrs"), piece.alias("raw")
        )

    return bind(
        pieces,
        lambda p: F.struct(
            F.get(p, F.lit(0)).alias("preamble"),
            F.transform(F.slice(p, F.lit(2), F.size(p)), parse).alias("markers"),
        ),
    )


def _named(marker: Column, fallback: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    return F.coalesce(filled(entry_value(marker["attrs"], "title")), filled(marker["marker_id"]), fallback)


def _origin(marker: Column) -> Column:
    source = entry_value(marker["attrs"], "source")
    return F.coalesce(F.when(source != "", source), entry_value(marker["attrs"], "page"), F.lit(""))


def marker_sections(df: DataFrame, text: str = "text", title: str = "title", strip_html_tags: bool = True) -> DataFrame:
    """Add ``marked`` (parent sections with their child sections), marker counts and warnings.

    A child belongs to the last parent marker before it.
    """
    found = df.withColumn("_m", chunk_markers(text))
    indexed = F.transform(
        F.col("_m.markers"), lambda m, i: F.struct(m["kind"].alias("kind"), i.alias("at"))
    )
    parents_at = F.transform(F.filter(indexed, lambda m: m["kind"] == "parent_chunk"), lambda m: m["at"])
    spans = F.transform(
        parents_at,
        lambda at, i: F.struct(
            at.alias("start"), F.coalesce(F.get(parents_at, i + 1), F.size(F.col("_m.markers"))).alias("stop")
        ),
    )
    staged = found.withColumn("_spans", spans)
    markers = F.col("_m.markers")
    span_text = F.transform(
        F.col("_spans"),
        lambda s: F.array_join(F.transform(F.slice(markers, s["start"] + 1, s["stop"] - s["start"]), lambda m: m["raw"]), ""),
    )
    staged = (
        staged.withColumn("_parent_text", clean_markup_items(span_text, strip_html_tags))
        .withColumn("_piece_text", clean_markup_items(F.transform(markers, lambda m: m["raw"]), strip_html_tags))
        .withColumn("_preamble", clean_markup(F.col("_m.preamble"), strip_html_tags))
    )

    def children(span: Column, parent: Column, parent_name: Column) -> Column:
        inner = F.slice(markers, span["start"] + 2, span["stop"] - span["start"] - 1)
        texts = F.slice(F.col("_piece_text"), span["start"] + 2, span["stop"] - span["start"] - 1)

        def one(m: Column, i: Column) -> Column:
            name = _named(m, F.concat(F.lit("child"), (i + 1).cast("string")))
            declared = F.coalesce(entry_value(m["attrs"], "parent"), F.lit(""))
            clash = (declared != "") & (parent["marker_id"] != "") & (declared != parent["marker_id"])
            body = F.coalesce(F.get(texts, i), F.lit(""))
            return F.struct(
                F.when(parent_name != "", F.concat(parent_name, F.lit(" > "), name)).otherwise(name).alias("heading_path"),
                body.alias("text"),
                m["marker_id"].alias("child_marker_id"),
                _origin(m).alias("marker_source"),
                F.array_compact(
                    F.array(
                        F.when(
                            clash,
                            F.concat(F.lit("child_parent_mismatch:"), m["marker_id"], F.lit("->"), declared, F.lit("!="), parent["marker_id"]),
                        ),
                        F.when(body == "", F.concat(F.lit("empty_child_marker:"), m["marker_id"])),
                    )
                ).alias("notes"),
            )

        return F.transform(inner, one)

    def section(span: Column, i: Column) -> Column:
        parent = F.get(markers, span["start"])
        name = _named(parent, F.col(title))
        body = F.coalesce(F.get(F.col("_parent_text"), i), F.lit(""))
        return bind(
            children(span, parent, name),
            lambda kids: F.struct(
                name.alias("heading_path"),
                body.alias("text"),
                parent["marker_id"].alias("parent_marker_id"),
                _origin(parent).alias("marker_source"),
                F.transform(
                    F.filter(kids, lambda k: k["text"] != ""),
                    lambda k: F.struct(k["heading_path"], k["text"], k["child_marker_id"], k["marker_source"]),
                ).alias("children"),
                F.concat(
                    F.flatten(F.transform(kids, lambda k: k["notes"])),
                    F.when(body == "", F.array(F.concat(F.lit("empty_parent_marker:"), parent["marker_id"]))).otherwise(
                        F.array().cast("array<string>")
                    ),
                ).alias("notes"),
            ),
        )

    staged = staged.withColumn("_all", F.transform(F.col("_spans"), section))
    none = F.size("_spans") == 0
    general = F.when(none, F.array(F.lit("html_comment_markers_not_found"))).otherwise(
        F.when(F.col("_preamble") != "", F.array(F.lit("text_before_first_parent_marker_ignored"))).otherwise(
            F.array().cast("array<string>")
        )
    )
    return (
        staged.withColumn("marker_parent_count", F.size("_spans"))
        .withColumn("marker_child_count", F.size(F.filter(markers, lambda m: m["kind"] == "child_chunk")))
        .withColumn(
            "marker_warnings", F.concat(general, F.flatten(F.transform(F.col("_all"), lambda s: s["notes"])))
        )
        .withColumn(
            "marked",
            F.transform(
                F.filter(F.col("_all"), lambda s: s["text"] != ""),
                lambda s: F.struct(s["heading_path"], s["text"], s["parent_marker_id"], s["marker_source"], s["children"]),
            ),
        )
        .drop("_m", "_spans", "_parent_text", "_piece_text", "_preamble", "_all")
    )


# ---------------------------------------------------------------- rules


def chunking_rules(meta=None, corpus=None) -> Column:
    """Effective rules of a document: its own metadata, else its corpus, else the defaults.

    ``meta`` is a ``map<string,string>`` column, ``corpus`` a struct column with the same
    field names (any may be missing from the struct type).
    """

    def pick(key: str, default) -> Column:
        own = F.when(F.col(meta)[key] != "", F.col(meta)[key]) if meta is not None else F.lit(None).cast("string")
        shared = F.col(corpus)[key] if corpus is not None else F.lit(None)
        if key == "parent_split_levels":
            shared = F.array_join(shared, ",") if corpus is not None else F.lit(None).cast("string")
            return F.coalesce(own, shared, F.lit(",".join(str(n) for n in default)))
        return F.coalesce(own, shared.cast("string"), F.lit(str(default).lower() if isinstance(default, bool) else str(default)))

    levels = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform(F.split(pick("parent_split_levels", DEFAULTS["parent_split_levels"]), "[,| ]+"), lambda v: v.try_cast("int")),
                lambda n: n.isNotNull() & n.between(1, 6),
            )
        )
    )
    mode = F.lower(strip(pick("chunking_mode", "auto")))
    floors = {"max_parent_chars": 500, "min_parent_chars": 0, "child_max_chars": 200, "child_overlap_chars": 0}
    return F.struct(
        F.when(F.size(levels) > 0, levels).otherwise(F.array(F.lit(2))).alias("parent_split_levels"),
        *[safe_int(pick(k, DEFAULTS[k]), DEFAULTS[k], f).alias(k) for k, f in floors.items()],
        safe_bool(pick("force_heading_split", False)).alias("force_heading_split"),
        safe_bool(pick("auto_descend", False)).alias("auto_descend"),
        F.when(mode.isin(MODES), mode).otherwise(F.lit("auto")).alias("chunking_mode"),
    )


def rules_label(rules) -> Column:
    c = col(rules)

    def flag(name: str) -> Column:
        return F.when(c[name], F.lit("True")).otherwise(F.lit("False"))

    return F.concat(
        F.lit("levels="), F.array_join(c["parent_split_levels"].cast("array<string>"), ","),
        F.lit(";max_parent="), c["max_parent_chars"].cast("string"),
        F.lit(";min_parent="), c["min_parent_chars"].cast("string"),
        F.lit(";child="), c["child_max_chars"].cast("string"),
        F.lit(";overlap="), c["child_overlap_chars"].cast("string"),
        F.lit(";force="), flag("force_heading_split"),
        F.lit(";auto_descend="), flag("auto_descend"),
        F.lit(";mode="), c["chunking_mode"],
    )


# ---------------------------------------------------------------- document pipeline


def chunk_documents(df: DataFrame, rules: str = "chunking", markers: bool = True, strip_html_tags: bool = True) -> DataFrame:
    """Add ``sections`` to (corpus_id, source_file, title, text, rules ...) rows.

    Each section carries its child passages.  ``markers=False`` skips the marker
    comment path for corpora known to have none.
    """
    heading = F.transform(
        F.col("_heading"),
        lambda s: F.struct(
            s["heading_path"], s["text"],
            F.lit("").alias("parent_marker_id"), F.lit("").alias("marker_source"),
            F.transform(
                child_chunks(s["text"], s["heading_path"], F.col(rules)["child_max_chars"], F.col(rules)["child_overlap_chars"], clean=True),
                lambda c: F.struct(c["heading_path"], c["text"], F.lit("").alias("child_marker_id"), F.lit("").alias("marker_source")),
            ).alias("children"),
        ),
    )
    body = F.col("_body")  # made once, referred to many times
    if not markers:
        return (
            df.withColumn("_body", unix_newlines("text"))
            .withColumn("_heading", parent_sections(body, "title", rules, clean=True))
            .withColumn("sections", heading)
            .withColumn("chunking_method", F.lit("heading"))
            .withColumn("marker_parent_count", F.lit(0))
            .withColumn("marker_child_count", F.lit(0))
            .withColumn("marker_warnings", F.array().cast("array<string>"))
            .drop("_heading", "_body")
        )

    marked = marker_sections(df, "text", "title", strip_html_tags)
    mode = F.col(rules)["chunking_mode"]
    wants = (mode == "html_comment") | ((mode == "auto") & (F.col("marker_parent_count") > 0))
    uses = wants & (F.size("marked") > 0)

    def marked_children(s: Column) -> Column:
        size, back = F.col(rules)["child_max_chars"], F.col(rules)["child_overlap_chars"]
        plain = F.transform(
            child_chunks(s["text"], s["heading_path"], size, back),
            lambda c: F.struct(c["heading_path"], c["text"], F.lit("").alias("child_marker_id"), s["marker_source"].alias("marker_source")),
        )
        cut = F.flatten(
            F.transform(
                s["children"],
                lambda k: F.when(F.length(k["text"]) <= size, F.array(k)).otherwise(
                    F.transform(
                        pack_paragraphs(k["text"], k["heading_path"], size, back),
                        lambda p: F.struct(p["heading_path"], p["text"], k["child_marker_id"], k["marker_source"]),
                    )
                ),
            )
        )
        return F.when(F.size(s["children"]) == 0, plain).otherwise(cut)

    by_marker = F.transform(
        F.col("marked"),
        lambda s: F.struct(
            s["heading_path"], s["text"], s["parent_marker_id"], s["marker_source"], marked_children(s).alias("children")
        ),
    )
    return (
        marked.withColumn("_body", F.when(~uses, unix_newlines("text")))
        .withColumn("_heading", F.when(~uses, parent_sections(body, "title", rules, clean=True)))
        .withColumn("sections", F.when(uses, by_marker).otherwise(heading))
        .withColumn("chunking_method", F.when(uses, F.lit("html_comment")).otherwise(F.lit("heading")))
        .withColumn(
            "marker_warnings",
            F.when(uses, F.col("marker_warnings"))
            .when(wants, F.concat("marker_warnings", F.array(F.lit("fallback_to_heading_chunking"))))
            .otherwise(F.array().cast("array<string>")),
        )
        .withColumn("marker_parent_count", F.when(wants, F.col("marker_parent_count")).otherwise(0))
        .withColumn("marker_child_count", F.when(wants, F.col("marker_child_count")).otherwise(0))
        .drop("_heading", "_body", "marked")
    )


def _carried(df: DataFrame) -> list[str]:
    skip = {"text", "sections", "chunking", "meta", "marker_warnings", "marker_parent_count", "marker_child_count", "chunking_method"}
    return [c for c in df.columns if c not in skip and not c.startswith("_")]


def parent_rows(chunked: DataFrame, strip_html_tags: bool = True) -> DataFrame:
    """One row per parent section."""
    keep = _carried(chunked)
    out = each(chunked, "sections", *keep, "chunking_method")
    return out.select(
        content_id(
            "corpus_id", "source_file", F.lit("parent"), (F.col("_pos") + 1).cast("string"),
            F.col("_s.parent_marker_id"), F.col("_s.heading_path"),
        ).alias("parent_id"),
        *keep,
        F.col("_s.heading_path").alias("heading_path"),
        clean_markup(F.col("_s.text"), strip_html_tags).alias("text"),
        "chunking_method",
        F.col("_s.parent_marker_id").alias("parent_marker_id"),
        F.col("_s.marker_source").alias("marker_source"),
        (F.col("_pos") + 1).alias("parent_no"),
    )


def child_rows(chunked: DataFrame, strip_html_tags: bool = True) -> DataFrame:
    """One row per child passage."""
    keep = _carried(chunked)
    parents = each(chunked, "sections", *keep, "chunking_method")
    kids = each(
        parents, "_s.children", *keep, "chunking_method",
        content_id(
            "corpus_id", "source_file", F.lit("parent"), (F.col("_pos") + 1).cast("string"),
            F.col("_s.parent_marker_id"), F.col("_s.heading_path"),
        ).alias("parent_id"),
        F.col("_s.parent_marker_id").alias("parent_marker_id"),
        (F.col("_pos") + 1).alias("parent_no"),
        item="_c", pos="_cpos",
    )
    clean = kids.withColumn("_t", clean_markup(F.col("_c.text"), strip_html_tags))
    return clean.select(
        content_id(
            "parent_id", F.lit("child"), (F.col("_cpos") + 1).cast("string"), F.col("_c.child_marker_id"),
            F.substring("_t", 1, 80),
        ).alias("child_id"),
        "parent_id",
        *keep,
        F.col("_c.heading_path").alias("heading_path"),
        F.col("_t").alias("text"),
        "chunking_method", "parent_marker_id",
        F.col("_c.child_marker_id").alias("child_marker_id"),
        F.col("_c.marker_source").alias("marker_source"),
        "parent_no",
        (F.col("_cpos") + 1).alias("child_no"),
    )


def configured_heading_count(text, levels, clean: bool = False) -> Column:
    """Heading lines whose level is in ``levels`` (an ``array<int>`` column)."""
    marks = F.regexp_extract_all(
        F.concat(F.lit("\n"), _unix(text, clean)), F.lit(r"(?U)\n(#{1,6})[^\S\n]+\S"), F.lit(1)
    )
    return F.size(F.filter(marks, lambda m: F.array_contains(col(levels), F.length(m))))


def report_warnings(source_chars, parent_count, child_count, longest, shortest, headings, rules) -> Column:
    c = col(rules)
    parents, kids = col(parent_count), col(child_count)
    checks = [
        (col(longest) > c["max_parent_chars"], "parent_over_max_chars"),
        ((c["min_parent_chars"] > 0) & (col(shortest) < c["min_parent_chars"]), "parent_under_min_chars"),
        (
            (parents > 0) & (kids > 0) & (F.abs(parents - kids) <= F.greatest(F.lit(1.0), parents * 0.1)),
            "parent_child_counts_too_close",
        ),
        ((col(source_chars) > c["max_parent_chars"]) & (parents <= 1), "large_document_not_split"),
        (c["force_heading_split"] & (col(headings) == 0), "configured_headings_not_found"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in checks]))


def chunk_report(chunked: DataFrame, rules: str = "chunking") -> DataFrame:
    """Audit row per document; computed inside the row, no aggregation needed."""
    lengths = F.transform("sections", lambda s: F.length(s["text"]))
    kids = F.aggregate(F.transform("sections", lambda s: F.size(s["children"])), F.lit(0), lambda a, n: a + n)
    total = F.aggregate("_len", F.lit(0), lambda a, n: a + n)
    staged = (
        chunked.withColumn("_len", lengths)
        .withColumn("_body", unix_newlines("text"))
        .withColumn("source_chars", F.length("_body"))
        .withColumn("parent_count", F.size("sections"))
        .withColumn("child_count", kids)
        .withColumn("parent_min_chars", F.coalesce(F.array_min("_len"), F.lit(0)))
        .withColumn("parent_max_chars", F.coalesce(F.array_max("_len"), F.lit(0)))
        .withColumn("configured_heading_count", configured_heading_count("_body", F.col(rules)["parent_split_levels"], clean=True))
    )
    warned = report_warnings(
        "source_chars", "parent_count", "child_count", "parent_max_chars", "parent_min_chars",
        "configured_heading_count", rules,
    )
    return staged.select(
        "corpus_id", "source_file", "title", "source_chars", "parent_count", "child_count",
        F.coalesce(F.round(F.try_divide(F.col("child_count").cast("double"), F.col("parent_count")), 2), F.lit(0.0)).alias("children_per_parent"),
        "parent_min_chars", "parent_max_chars",
        F.coalesce(F.round(F.try_divide(total.cast("double"), F.col("parent_count")), 1), F.lit(0.0)).alias("parent_avg_chars"),
        "configured_heading_count",
        rules_label(rules).alias("chunking"),
        F.array_join(F.concat(warned, "marker_warnings"), "|").alias("warnings"),
        "chunking_method", "marker_parent_count", "marker_child_count",
        F.array_join("marker_warnings", "|").alias("marker_warnings"),
    )


def report_by_corpus(report: DataFrame) -> DataFrame:
    """Files, parents, children and warned files per corpus."""
    return report.groupBy(F.coalesce("corpus_id", F.lit("unknown")).alias("corpus_id")).agg(
        F.count("*").alias("files"),
        F.sum("parent_count").alias("parent_count"),
        F.sum("child_count").alias("child_count"),
        F.count_if(F.col("warnings") != "").alias("warning_count"),
    )


def report_warning_list(report: DataFrame, limit: int = 100) -> DataFrame:
    return (
        report.filter(F.col("warnings") != "")
        .select("corpus_id", "source_file", "title", "warnings")
        .orderBy("corpus_id", "source_file")
        .limit(limit)
    )
