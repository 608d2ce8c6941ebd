"""Landed web pages to Markdown, titles, links and link manifests."""

from __future__ import annotations

from functools import reduce
from itertools import count, product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null, col, lines, natural_sort_key, squeeze, squeeze_lines, strip, text_or_empty
from corpusloom.functions.unicode import html_unescape, html_unescape_lines
from corpusloom.functions.values import bind, each, file_id
from corpusloom.operators.ranking import ordinal
from corpusloom.session import materialized

# Boilerplate lines dropped from pages, and lines that end an article.
SKIP_LINES = [
    "すべての機能をご利用いただくにはJavascriptを有効にしてください。",
    "このページの先頭へ",
    "はい いいえ",
]
STOP_MARKERS = [
    "お問い合わせ先",
    "このコンテンツはお役にたちましたか？",
    "ご協力ありがとうございました",
    "サイトマップ（コンテンツ一覧）",
]
STOP_PREFIX = "税の情報・手続・用紙"
SITE_NAME = "国税庁"
NO_PAGE_TEXT = "[No extractable text on this page]"
PDF_STOP_WORDS = ["資 産 課 税 課 情 報", "国 税 庁", "資産課税 課"]
PDF_END_WORDS = ["について（情報）", "質疑応答事例"]
DROPPED_ELEMENTS = "script|style|noscript|svg|form|button|select|textarea"
BLOCK_ENDS = "p|div|section|article|main|tr|table|ul|ol|dl|dt|dd"


# ---------------------------------------------------------------- markdown


def _replaced(text: Column, pattern: str, by: str, *needles: str) -> Column:
    """``text`` with matches of ``pattern`` replaced; only texts that hold one of ``needles`` are searched.

    Every match must hold a needle, in any mixture of ASCII cases.
    """
    cases = sorted({"".join(letters) for needle in needles for letters in product(*[{c.lower(), c.upper()} for c in needle])})

    def searched(t: Column) -> Column:
        return F.when(reduce(or_, [F.contains(t, F.lit(c)) for c in cases]), F.regexp_replace(t, pattern, by)).otherwise(t)

    return bind(text, searched)


def html_to_markdown(html, skip_lines: list[str] = SKIP_LINES, ended: bool = False) -> Column:
    """HTML text to Markdown lines: headings, list items, table cells and image captions kept.

    With ``ended`` a character reference without its semicolon stays as it is (``&amp`` does not).
    """
    t = F.regexp_replace(text_or_empty(html), rf"(?is)<({DROPPED_ELEMENTS})\b[^>]*>.*?</\1>", "\n")
    # white space within an image tag first: a caption is one line
    def one_line_images(t: Column) -> Column:
        broken = F.regexp_extract_all(t, F.lit(r"(?is)(<img\b[^>]*[\r\n][^>]*>)"), F.lit(1))
        joined = F.aggregate(F.array_distinct(broken), t, lambda s, tag: F.replace(s, tag, F.regexp_replace(tag, r"\s+", " ")))
        return F.when(F.contains(t, F.lit("<i")) | F.contains(t, F.lit("<I")), joined).otherwise(t)

    t = _replaced(bind(t, one_line_images), r"""(?is)<img\b[^>]*\balt=["']([^"']+)["'][^>]*>""", "\n[画像: $1]\n", "<i")
    for level in range(1, 7):
        t = _replaced(t, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ", f"<h{level}")
    t = F.regexp_replace(t, r"(?i)</h[1-6]>|<br\s*/?>", "\n")
    t = _replaced(t, r"(?i)<li\b[^>]*>", "\n- ", "<li")
    t = _replaced(t, r"(?i)<(?:th|td)\b[^>]*>", " ", "<th", "<td")
    t = _replaced(t, r"(?i)</(?:th|td)>", " | ", "</th", "</td")
    t = F.regexp_replace(t, rf"(?i)</(?:li|{BLOCK_ENDS})>", "\n")
    t = html_unescape_lines(F.regexp_replace(t, r"<[^>]+>", ""), ended)
    t = squeeze_lines(_replaced(t, "\r\n?", "\n", "\r"))
    if skip_lines:
        t = F.array_join(F.filter(F.split(t, "\n", -1), lambda r: ~r.isin(skip_lines)), "\n")
    return strip(_replaced(t, "\n{3,}", "\n\n", "\n\n\n"))


def trim_main(markdown, stop_markers: list[str] = STOP_MARKERS, stop_prefix: str | None = STOP_PREFIX, allow_h2: bool = True) -> Column:
    """Keep from the first H1 (or H2) line to the line before the first stop marker."""

    def cut(rows: Column) -> Column:
        first_h1 = F.array_position(F.transform(rows, lambda r: F.rlike(r, F.lit(r"(?U)^#\s+"))), F.lit(True))
        first_h2 = F.array_position(F.transform(rows, lambda r: F.rlike(r, F.lit(r"(?U)^##\s+"))), F.lit(True))
        start = F.when(first_h1 > 0, first_h1)
        if allow_h2:
            start = start.when(first_h2 > 0, first_h2)
        start = start.otherwise(1).cast("int")
        kept = F.slice(rows, start, F.greatest(F.size(rows), F.lit(1)))

        def stops(line: Column) -> Column:
            plain = strip(F.regexp_replace(line, "^#+", ""))
            hit = plain.isin(stop_markers)
            return hit | plain.startswith(stop_prefix) if stop_prefix else hit

        # the first kept line is never a stop
        end = F.array_position(F.transform(F.slice(kept, F.lit(2), F.size(kept)), stops), F.lit(True)).cast("int")
        return F.when(end > 0, F.slice(kept, F.lit(1), end)).otherwise(kept)

    return strip(F.array_join(bind(lines(markdown), cut), "\n"))


def markdown_title(markdown, max_level: int = 2) -> Column:
    """First heading of level 1 (to ``max_level``), empty when there is none."""
    return squeeze(F.regexp_extract(text_or_empty(markdown), rf"(?m)^#{{1,{max_level}}}[^\S\n]+(.+)$", 1))


def html_title(html, site: str | None = SITE_NAME, ended: bool = False) -> Column:
    """Text of the ``<title>`` element without the site name suffix."""
    inner = F.regexp_extract(text_or_empty(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    t = squeeze(html_unescape(F.regexp_replace(inner, "<[^>]+>", ""), ended))
    return strip(F.regexp_replace(t, rf"(?U)\s*[｜|]\s*{site}\s*$", "")) if site else t


def page_title(markdown, html, fallback, ended: bool = False) -> Column:
    return F.coalesce(
        blank_to_null(markdown_title(markdown)), blank_to_null(html_title(html, ended=ended)), text_or_empty(fallback)
    )


def law_basis_date(markdown) -> Column:
    """``[令和… 現在法令等]`` note of an article."""
    return squeeze(F.regexp_extract(text_or_empty(markdown), r"\[(令和[^\]\n]+現在法令等)\]", 1))


def as_of_date_note(markdown) -> Column:
    """``令和n年n月n日現在`` note of a case page."""
    return squeeze(F.regexp_extract(text_or_empty(markdown), "(令和[0-9０-９]+年[0-9０-９]+月[0-9０-９]+日現在)", 1))


def convert_pages(pages: DataFrame, site: str | None = SITE_NAME) -> DataFrame:
    """(page_id, url, html) to (page_id, url, title, markdown, law_basis_date)."""
    md = pages.withColumn("_md", html_to_markdown("html")).withColumn("_md", trim_main("_md"))
    return md.select(
        "page_id", "url", page_title("_md", "html", "url").alias("title"), F.col("_md").alias("markdown"),
        law_basis_date("_md").alias("law_basis_date"),
    )


# ---------------------------------------------------------------- page text of scanned documents


def normalize_page_text(value) -> Column:
    """Spaces collapsed inside lines, blank-line runs reduced to one."""
    rows = F.transform(lines(F.replace(text_or_empty(value), F.lit("　"), F.lit(" "))), lambda r: strip(F.regexp_replace(r, "[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(rows, "\n"), "\n{3,}", "\n\n"))


def assemble_pages(pages: DataFrame, doc: str, page_no: str, text: str, run: int = 256) -> DataFrame:
    """One document per ``doc``: ``## Page n`` blocks in page order, page and character counts.

    Pages are first joined in runs of ``run`` so that a very long document is put
    together from few large parts instead of one long list in one task.
    """
    body = F.when(F.col(text) != "", F.col(text)).otherwise(F.lit(NO_PAGE_TEXT))
    block = F.concat(F.lit("## Page "), F.col(page_no).cast("string"), F.lit("\n\n"), body)
    tagged = pages.select(
        F.col(doc), F.col(page_no).alias("_no"), F.floor(F.col(page_no) / run).alias("_run"), block.alias("_block"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("_chars"),
    )

    def joined(order: str, value: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(order, value)))
        return F.array_join(F.transform(ordered, lambda e: e[value]), "\n\n")

    runs = tagged.groupBy(doc, "_run").agg(
        joined("_no", "_block").alias("_part"), F.count("*").alias("_pages"), F.sum("_chars").alias("_chars")
    )
    return runs.groupBy(doc).agg(
        joined("_run", "_part").alias("body"), F.sum("_pages").alias("page_count"), F.sum("_chars").alias("extracted_chars")
    )


def infer_document_title(first_page, metadata_title, default, head_lines: int | None = None, max_meta: int | None = None, max_read: int | None = None) -> Column:
    """Metadata title unless it is a file name or document number, else the first lines of page one.

    The limits (lines read, characters kept) are the caller's; without them nothing is cut.
    """
    meta = strip(F.get(F.split(normalize_page_text(metadata_title), "\n"), F.lit(0)))
    usable = (meta != "") & ~F.lower(meta).endswith(".pdf") & ~F.rlike(meta, F.lit(r"^[0-9]{6,}-[0-9]+$"))
    head = F.split(normalize_page_text(first_page), "\n", -1)
    head = head if head_lines is None else F.slice(head, 1, head_lines)
    first = F.struct(F.lit("").alias("title"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        clean = F.btrim(line, F.lit(" -―—\t"))
        blank = clean == ""
        stop = s["done"] | (blank & (s["title"] != ""))
        for word in PDF_STOP_WORDS:
            stop = stop | F.contains(clean, F.lit(word))
        number = F.rlike(clean, F.lit(r"^\d+$"))
        grown = F.when(stop & ~number | s["done"] | blank | number, s["title"]).otherwise(F.concat(s["title"], clean))
        ended = F.lit(False)
        for word in PDF_END_WORDS:
            ended = ended | F.contains(grown, F.lit(word))
        return F.struct(grown.alias("title"), (F.when(number & ~s["done"], F.lit(False)).otherwise(stop) | ended).alias("done"))

    read = F.aggregate(head, first, step, lambda s: s["title"])
    return (
        F.when(usable, meta if max_meta is None else F.substring(meta, 1, max_meta))
        .when(read != "", read if max_read is None else F.substring(read, 1, max_read))
        .otherwise(text_or_empty(default))
    )


# ---------------------------------------------------------------- links


def resolve_url(base, href) -> Column:
    """Absolute URL of a reference, without its fragment."""
    b, h = col(base), strip(text_or_empty(href))
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(b, r"[?#].*$", "")
    folder = F.when(F.length(page) > F.length(root), F.regexp_replace(page, "[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    full = (
        F.when(h == "", b)
        .when(F.rlike(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(page, h))
        .when(h.startswith("#"), b)
        .otherwise(F.concat(folder, h))
    )
    full = F.regexp_replace(full, r"#.*$", "")
    return F.when(F.rlike(full, F.lit(r"/\.\.?(?:[/?]|$)")), bind(full, _folded)).otherwise(full)


def _folded(url: Column) -> Column:
    """``.`` and ``..`` segments of the path taken away."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)/([^?#]*)(.*)$"
    parts = F.split(F.regexp_extract(url, shape, 2), "/", -1)
    none = F.array().cast("array<string>")

    def step(s: Column, p: Column) -> Column:
        up = F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
        return F.when(p == "..", up).when(p == ".", s).otherwise(F.concat(s, F.array(p)))

    kept = F.aggregate(parts, none, step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    whole = F.concat(F.regexp_extract(url, shape, 1), F.lit("/"), F.array_join(kept, "/"), F.regexp_extract(url, shape, 3))
    return F.when(F.rlike(url, F.lit(shape)), whole).otherwise(url)


def page_links(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """Anchors of each page in document order with the last H2/H3 closed before them."""
    parts = F.regexp_extract_all(
        text_or_empty("html"), F.lit(r"(?is)(<h[23]\b[^>]*>.*?</h[23]>|<a\b[^>]*>.*?</a>)"), F.lit(1)
    )
    first = F.struct(
        F.lit("").alias("h2"), F.lit("").alias("h3"),
        F.array().cast("array<struct<href:string,text:string,h2:string,h3:string>>").alias("out"),
    )

    def plain(part: Column) -> Column:
        return squeeze(F.regexp_replace(part, "<[^>]*>", ""))

    def step(s: Column, p: Column) -> Column:
        is_h2, is_h3 = F.rlike(p, F.lit("(?i)^<h2")), F.rlike(p, F.lit("(?i)^<h3"))

        def link(a: Column) -> Column:
            href = F.regexp_extract(a, r"""(?is)^<a\b[^>]*\bhref\s*=\s*["']?([^"'>\s]*)""", 1)
            return F.struct(href.alias("href"), plain(a).alias("text"), s["h2"].alias("h2"), s["h3"].alias("h3"))

        # an anchor may stand within a heading, which counts from its end on
        anchors = F.regexp_extract_all(p, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
        links = F.filter(F.transform(anchors, link), lambda l: (l["href"] != "") & (l["text"] != ""))
        return F.struct(
            F.when(is_h2, plain(p)).otherwise(s["h2"]).alias("h2"),
            F.when(is_h2, F.lit("")).when(is_h3, plain(p)).otherwise(s["h3"]).alias("h3"),
            F.concat(s["out"], links).alias("out"),
        )

    found = each(pages, F.aggregate(parts, first, step, lambda s: s["out"]), order, F.col("url").alias("source_url"), item="_l", pos="position")
    decoded = found.withColumn("_text", squeeze(html_unescape(F.col("_l.text"))))
    return decoded.select(
        order, "source_url", "position", resolve_url("source_url", html_unescape(F.col("_l.href"))).alias("url"),
        F.col("_text").alias("text"), squeeze(html_unescape(F.col("_l.h2"))).alias("h2"), squeeze(html_unescape(F.col("_l.h3"))).alias("h3"),
    )


def first_links(links: DataFrame, order: str = "page_id") -> DataFrame:
    """First occurrence of each URL in page order, then position."""
    # map-side minimum first: a URL linked from every page shuffles one row per task
    ranked = links.groupBy("url").agg(F.min_by(F.struct(order, "position", "source_url", "text", "h2", "h3"), F.struct(order, "position")).alias("_f"))
    return ranked.select("url", "_f.*")


def scoped_links(links: DataFrame, url: str = "url", host: str | None = None, prefix: str | None = None, suffix: str | None = ".htm") -> DataFrame:
    """Links with an HTTP scheme on the given host, under the prefix, with the path suffix."""
    u = F.col(url)
    test = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https")
    if host:
        test = test & (F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1) == host)
    if prefix:
        test = test & u.startswith(prefix)
    if suffix:
        test = test & F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).endswith(suffix)
    return links.filter(test)


def link_manifest(links: DataFrame, category, status) -> DataFrame:
    """Counts by category and by status in one pass: (kind, value, n)."""
    pairs = F.array(
        F.struct(F.lit("category").alias("kind"), text_or_empty(category).alias("value")),
        F.struct(F.lit("status").alias("kind"), text_or_empty(status).alias("value")),
    )
    return links.select(F.inline(pairs)).groupBy("kind", "value").agg(F.count("*").alias("n"))


def reachable_pages(edges: DataFrame, starts: DataFrame, max_pages: int = 0, max_rounds: int | None = None) -> DataFrame:
    """Pages reachable from the start pages, with their distance (runs one job per round).

    ``edges`` has (src, dst), ``starts`` has (url).  Each round expands the frontier only and
    writes only what is new, so each page is written once; lost executors do not replay the walk.
    ``max_pages`` is the crawl limit: the walk stops once it is reached.  A walk that is
    not done after ``max_rounds`` rounds is an error.
    """
    links = materialized(edges.select("src", "dst").distinct())
    frontier = seen = materialized(starts.select("url").distinct().withColumn("depth", F.lit(0)))
    found = frontier.count()
    for depth in count(1):
        if max_pages and found >= max_pages:
            break
        if max_rounds is not None and depth > max_rounds:
            raise ValueError(f"pages are left after {max_rounds} rounds")
        step = frontier.join(links, frontier["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        frontier = materialized(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        new = frontier.count()
        if not new:
            break
        found += new
        seen = seen.unionByName(frontier)
    if max_pages:
        seen = seen.orderBy("depth", natural_sort_key("url")).limit(max_pages)
    return seen


# ---------------------------------------------------------------- stable file names


def planned_names(documents: DataFrame, prefix, path: str = "path", document_id=None) -> DataFrame:
    """(path, new_path): corpus prefix plus document id, leading token or path hash.

    Equal names in one folder are numbered ``_2``, ``_3`` … in path order.
    """
    p = F.col(path)
    folder, stem = F.regexp_replace(p, "[^/]*$", ""), F.regexp_replace(F.regexp_extract(p, "([^/]*)$", 1), r"\.[^.]*$", "")
    own = file_id(document_id) if document_id is not None else F.lit("")
    token = file_id(F.regexp_extract(stem, r"^([0-9A-Za-z][0-9A-Za-z_\-.]*)(?:_|$)", 1))
    ident = F.coalesce(blank_to_null(own), blank_to_null(token), F.substring(F.sha1(p), 1, 10))
    named = documents.select(p.alias("path"), folder.alias("_folder"), col(prefix).alias("_prefix"), ident.alias("_ident"))
    full = F.concat_ws("_", "_prefix", "_ident")
    base = F.when((F.col("_ident") == F.col("_prefix")) | F.col("_ident").startswith(F.concat(F.col("_prefix"), F.lit("_"))), F.col("_ident")).otherwise(full)
    numbered = ordinal(named.withColumn("_base", base).withColumn("_full", full), ["_folder", "_base"], ["path"], "_n")
    name = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_full", F.lit("_"), F.col("_n").cast("string")))
    return numbered.select("path", F.concat("_folder", name, F.lit(".md")).alias("new_path"))


def remap_keys(rows: DataFrame, mapping: DataFrame, key: str = "source_file") -> DataFrame:
    """Replace ``key`` by its new value where the (old, new) mapping has one; adds ``changed``."""
    joined = rows.join(mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(key) == F.col("_old"), "left")
    kept = [c for c in rows.columns if c != key]
    return joined.select(
        *kept, F.coalesce("_new", key).alias(key), F.col("_new").isNotNull().alias("changed")
    )

