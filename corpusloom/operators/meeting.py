"""Meeting slides and minutes: records, events, passages and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, blank_to_null, col, lines, strip, table_row, text_or_empty, unix_newlines, unquote
from corpusloom.functions.unicode import casefold
from corpusloom.functions.values import BLANK_WORDS, content_id, each, entries_to_map, entry_value, is_blank, null_if_blank, positive, safe_float
from corpusloom.operators.documents import front_matter_body, front_matter_entries
from corpusloom.operators.matching import contained_terms
from corpusloom.operators.ranking import dedupe_first

# Document types, event types and the keyword lists of the question parser.
DOCUMENT_TYPES = ["meeting_slide_deck", "meeting_minutes"]
EVENT_TYPES = [
    "proposal",
    "discussion",
    "concern",
    "decision",
    "action_item",
    "change",
    "report",
    "completion",
    "pending",
    "rejection",
]
STATE_TYPES = ["decision", "change", "completion", "report"]
DONE_WORDS = ["done", "closed", "completed", "完了", "対応済み", "終了"]
TIMELINE_WORDS = [
    "時系列",
    "経緯",
    "これまでの流れ",
    "いつ決まった",
    "変遷",
    "前回から",
    "何が変わった",
    "宿題の状況",
    "未完了事項",
    "決定事項だけ",
    "方針変更だけ",
    "懸念事項の変遷",
]
TYPE_WORDS = [
    ("decision", ["決定事項", "決まった", "決定だけ", "いつ決まった"]),
    ("action_item", ["宿題", "対応事項", "アクションアイテム"]),
    ("pending", ["未完了", "保留", "ペンディング"]),
    ("concern", ["懸念", "リスク"]),
    ("change", ["方針変更", "変更"]),
    ("rejection", ["却下", "見送り"]),
    ("completion", ["完了", "対応済み"]),
    ("discussion", ["議論", "論点"]),
    ("proposal", ["提案", "案"]),
    ("report", ["報告"]),
]
MINUTES_LISTS = [
    ("decisions", "decision", ["decision", "summary", "event_summary"]),
    ("concerns", "concern", ["concern", "summary", "event_summary"]),
    ("action_items", "action_item", ["action_item", "task", "summary", "event_summary"]),
    ("pending_items", "pending", ["pending_item", "pending", "summary", "event_summary"]),
    ("rejected_items", "rejection", ["rejected_item", "rejection", "summary", "event_summary"]),
]
SLIDE_SUMMARY = ["summary", "event_summary", "proposal", "report", "text"]
META = ["meeting_id", "meeting_name", "meeting_date", "source_file"]
ITEM = "array<struct<key:string,value:string>>"


def parse_meetings(files: DataFrame) -> DataFrame:
    """(source_file, text) to one row per meeting document with its header, body, errors and warnings."""
    e = F.col("_e")
    entries = files.withColumn("_e", front_matter_entries("text", "strict")).withColumn("body", front_matter_body("text", "strict"))

    def meta(key: str) -> Column:
        return strip(F.coalesce(entry_value(e, key), F.lit("")))

    kind = meta("document_type")
    unsupported = ~kind.isin(DOCUMENT_TYPES)
    named = F.coalesce(F.col("source_file"), meta("source_file"))
    errors = F.array_compact(
        F.array(
            F.when(unsupported, F.concat(F.lit("unsupported document_type: "), F.coalesce(blank_to_null(kind), F.lit("(missing)")))),
            F.when(~unsupported & (meta("meeting_date") == ""), F.concat(named, F.lit(": meeting_date is required"))),
        )
    )
    return entries.select(
        F.col("source_file").alias("markdown_file"),
        F.coalesce(blank_to_null(meta("source_file")), F.col("source_file")).alias("source_file"),
        kind.alias("document_type"),
        meta("meeting_id").alias("meeting_id"),
        F.coalesce(blank_to_null(meta("meeting_name")), meta("deck_title")).alias("meeting_name"),
        meta("meeting_date").alias("meeting_date"),
        *[null_if_blank(meta(k)).alias(k) for k in ("fiscal_year", "department", "confidentiality")],
        unix_newlines("body").alias("body"),
        errors.alias("errors"),
        F.array_compact(F.array(F.when(~unsupported & (meta("meeting_id") == ""), F.concat(named, F.lit(": meeting_id is missing"))))).alias("warnings"),
    )


def accepted(meetings: DataFrame) -> DataFrame:
    return meetings.filter(F.size("errors") == 0)


def quarantined(meetings: DataFrame) -> DataFrame:
    return meetings.filter(F.size("errors") > 0)


# ---------------------------------------------------------------- record syntax


def _key_value(line: Column) -> Column:
    at = F.position(F.lit(":"), line)
    return F.struct(
        F.when(at > 0, strip(F.substr(line, F.lit(1), at - 1))).otherwise(F.lit("")).alias("key"),
        unquote(F.when(at > 0, F.substr(line, at + 1, F.length(line))).otherwise(line)).alias("value"),
    )


def h2_sections(text) -> Column:
    """(key, value) per H2 section, keys in lower snake case."""
    pieces = F.split(F.concat(F.lit("\n"), text_or_empty(text)), r"(?U)\n(?=##[^\S\n]+\S)", -1)
    return F.transform(
        F.filter(pieces, lambda p: p.startswith("##")),
        lambda p: F.struct(
            F.btrim(F.regexp_replace(F.lower(strip(F.regexp_extract(p, r"(?U)^##[^\S\n]+([^\n]+)", 1))), "[^a-z0-9_]+", "_"), F.lit("_")).alias("key"),
            strip(F.regexp_replace(p, r"^[^\n]*", "")).alias("value"),
        ),
    )


def key_values(text) -> Column:
    """``key: value`` lines (optionally bulleted) as entries."""
    rows = F.transform(lines(text_or_empty(text)), lambda r: F.regexp_replace(strip(r), r"(?U)^- \s*", ""))
    return F.filter(F.transform(rows, _key_value), lambda e: e["key"] != "")


def list_items(text) -> Column:
    """Bullet list as an array of entry arrays; continuation lines join their bullet."""
    body = text_or_empty(text)
    kept = F.filter(lines(body), lambda r: strip(r) != "")
    bulleted = F.array_join(kept, "\n")
    chunks = F.filter(F.split(F.concat(F.lit("\n"), bulleted), r"(?U)\n(?=[^\S\n]*-)", -1), lambda c: F.rlike(c, F.lit(r"(?U)^[^\S\n]*-")))

    def item(chunk: Column) -> Column:
        rows = F.split(chunk, "\n", -1)
        head = strip(F.regexp_replace(F.get(rows, F.lit(0)), r"(?U)^\s*-\s*", ""))
        pair = _key_value(head)
        first = (
            F.when(pair["key"] != "", F.array(pair))
            .when(head != "", F.array(F.struct(F.lit("summary").alias("key"), head.alias("value"))))
            .otherwise(F.array().cast(ITEM))
        )
        rest = F.transform(F.slice(rows, F.lit(2), F.size(rows)), strip)
        pairs = F.filter(F.transform(rest, _key_value), lambda e: e["key"] != "")
        loose = F.array_join(F.filter(rest, lambda r: _key_value(r)["key"] == ""), "\n")
        prose = F.when(loose != "", F.array(F.struct(F.lit("text").alias("key"), loose.alias("value")))).otherwise(F.array().cast(ITEM))
        return F.concat(first, pairs, prose)

    def meaningful(entries: Column) -> Column:
        return F.exists(entries, lambda e: ~((e["key"] == "event_type") & (F.lower(unquote(e["value"])) == "none")) & ~is_blank(e["value"]))

    return F.when(is_blank(body), F.array().cast(f"array<{ITEM}>")).otherwise(F.filter(F.transform(chunks, item), meaningful))


def tag_list(text) -> Column:
    """Distinct tags of a bulleted or comma-separated list."""
    rows = F.transform(lines(text_or_empty(text)), lambda r: F.regexp_replace(strip(r), r"(?U)^- \s*", ""))
    parts = F.transform(F.flatten(F.transform(rows, lambda r: F.split(r, "[,、]", -1))), strip)
    return F.array_distinct(F.filter(parts, lambda p: ~is_blank(p)))


def _first_value(item: Column, keys: list[str]) -> Column:
    return F.coalesce(*[null_if_blank(entry_value(item, k)) for k in keys], F.lit(""))


def _either(item: Column, *keys: str) -> Column:
    return F.coalesce(*[blank_to_null(entry_value(item, k)) for k in keys])


# ---------------------------------------------------------------- records


def slides(meetings: DataFrame) -> DataFrame:
    """One row per ``# Slide n: title`` of the slide decks."""
    decks = accepted(meetings).filter("document_type = 'meeting_slide_deck'")
    parts = F.filter(F.split(F.concat(F.lit("\n"), "body"), r"(?U)\n(?=#[^\S\n]+Slide[^\S\n]+\d+)", -1), lambda p: F.rlike(p, F.lit(r"(?U)^#\s+Slide\s+\d")))
    rows = each(decks, parts, *META, "markdown_file", "document_type", item="_block", pos="_p")
    rows = rows.withColumn("_head", F.split_part("_block", F.lit("\n"), F.lit(1))).withColumn("_s", h2_sections("_block"))
    s = F.col("_s")
    rows = rows.withColumn("_m", key_values(F.coalesce(entry_value(s, "slide_metadata"), F.lit(""))))
    m = F.col("_m")
    number = F.regexp_extract("_head", r"(?U)^#\s+Slide\s+(\d+)", 1).try_cast("int")
    slide_no = F.coalesce(unquote(F.coalesce(entry_value(m, "slide_no"), F.lit(""))).try_cast("int"), number, F.col("_p") + 1)
    title = F.regexp_extract("_head", r"(?U)^#\s+Slide\s+\d+\s*:?\s*(.*?)\s*$", 1)

    def field(key: str) -> Column:
        return null_if_blank(F.coalesce(entry_value(s, key), F.lit("")))

    return rows.select(
        *META, "markdown_file", "document_type", slide_no.alias("slide_no"),
        strip(F.coalesce(blank_to_null(entry_value(m, "slide_title")), blank_to_null(title), F.concat(F.lit("Slide "), slide_no.cast("string")))).alias("slide_title"),
        null_if_blank(F.coalesce(entry_value(m, "agenda"), F.lit(""))).alias("agenda"),
        null_if_blank(F.coalesce(entry_value(m, "section"), F.lit(""))).alias("section"),
        strip(F.coalesce(entry_value(s, "visible_text"), F.lit(""))).alias("visible_text"),
        field("tables").alias("tables_markdown"), field("figures_and_charts").alias("figures_and_charts"), field("visual_summary").alias("visual_summary"),
        field("speaker_notes").alias("speaker_notes"), list_items(entry_value(s, "proposed_events")).alias("proposed_events"),
        tag_list(entry_value(s, "search_tags")).alias("search_tags"),
    )


def minutes_sections(meetings: DataFrame) -> DataFrame:
    """One row per agenda section of the minutes."""
    docs = accepted(meetings).filter("document_type = 'meeting_minutes'")
    parts = F.split(F.concat(F.lit("\n"), "body"), r"(?U)\n(?=#[^\S\n]+\S)", -1)
    rows = each(docs, parts, *META, "markdown_file", "document_type", item="_block", pos="section_no")
    rows = rows.withColumn("section_title", strip(F.regexp_extract("_block", r"(?U)^#[^\S\n]+([^\n]+)", 1)))
    rows = rows.filter(F.contains("section_title", F.lit("議題")) | F.col("section_title").startswith("Agenda"))
    rows = rows.withColumn("_s", h2_sections("_block"))
    s = F.col("_s")
    rows = rows.withColumn("_m", key_values(F.coalesce(entry_value(s, "section_metadata"), F.lit(""))))

    def meta(key: str) -> Column:
        return null_if_blank(F.coalesce(entry_value(F.col("_m"), key), F.lit("")))

    def field(key: str) -> Column:
        return null_if_blank(F.coalesce(entry_value(s, key), F.lit("")))

    return rows.select(
        *META, "markdown_file", "document_type", "section_no", meta("agenda").alias("agenda"), meta("topic").alias("topic"), "section_title",
        meta("section_type").alias("section_type"), field("explanation").alias("explanation"), field("discussion").alias("discussion"),
        *[list_items(entry_value(s, name)).alias(name) for name, _, _ in MINUTES_LISTS],
        tag_list(entry_value(s, "search_tags")).alias("search_tags"),
    )


def slides_with_minutes(slide_rows: DataFrame, minutes_rows: DataFrame) -> DataFrame:
    """Slides and minutes sections of the same meeting."""
    left = slide_rows.filter("meeting_id <> ''").select("meeting_id", "slide_no", "slide_title")
    return left.join(minutes_rows.select("meeting_id", "section_title", "topic"), "meeting_id")


# ---------------------------------------------------------------- events


def _ref(**values: Column) -> Column:
    names = ["source_type", "document_type", "source_file", "agenda", "section_title", "slide_no", "slide_title", "item_type"]
    return F.array(F.struct(*[(values[n] if n in values else F.lit(None)).cast("int" if n == "slide_no" else "string").alias(n) for n in names]))


def _event(rows: DataFrame, event_type: Column, topic: Column, summary: Column, refs: Column, fallback: Column) -> DataFrame:
    item = F.col("item")

    def own(*keys: str) -> Column:
        return null_if_blank(F.coalesce(_either(item, *keys), F.lit("")))

    return rows.select(
        content_id("meeting_id", "meeting_date", event_type, topic, summary, fallback).alias("event_id"), "meeting_id", "meeting_name", "meeting_date",
        F.coalesce(own("event_date", "date"), F.col("meeting_date")).alias("event_date"), unquote(topic).alias("topic"), own("subtopic").alias("subtopic"),
        event_type.alias("event_type"), unquote(summary).alias("event_summary"), own("before_state").alias("before_state"), own("after_state").alias("after_state"),
        own("owner", "担当").alias("owner"), own("due_date", "期限").alias("due_date"), own("status", "状態").alias("status"), refs.alias("source_refs"),
        safe_float(own("confidence"), None).alias("confidence"), "markdown_file", "warning",
    )


def slide_events(slide_rows: DataFrame) -> DataFrame:
    """Proposed events of slides; unknown types are proposals, decisions are downgraded."""
    rows = each(slide_rows, "proposed_events", "*", item="item", pos="_p")
    raw = F.lower(unquote(F.coalesce(_either(F.col("item"), "event_type", "type"), F.lit("proposal"))))
    rows = rows.withColumn("_raw", raw).filter(~F.col("_raw").isin("", "none")).withColumn("_summary", _first_value(F.col("item"), SLIDE_SUMMARY)).filter("_summary <> ''")
    kind = F.when(F.col("_raw").isin(EVENT_TYPES) & (F.col("_raw") != "decision"), F.col("_raw")).otherwise(F.lit("proposal"))
    rows = rows.withColumn("warning", F.when(F.col("_raw") == "decision", F.format_string("%s slide %d: proposed event was downgraded from decision to proposal", "source_file", "slide_no")))
    topic = F.coalesce(blank_to_null(_first_value(F.col("item"), ["topic", "agenda"])), F.col("agenda"), F.col("slide_title"))
    refs = _ref(source_type=F.lit("slide"), document_type=F.col("document_type"), source_file=F.col("source_file"), slide_no=F.col("slide_no"), slide_title=F.col("slide_title"))
    return _event(rows, kind, topic, F.col("_summary"), refs, F.concat(F.lit("slide:"), F.col("slide_no").cast("string"), F.lit(":"), (F.col("_p") + 1).cast("string")))


def minutes_events(minutes_rows: DataFrame) -> DataFrame:
    """Events of the five item lists and the discussion of each section."""
    lists = F.array(
        *[
            F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.array(*[F.lit(k) for k in keys]).alias("keys"), F.col(name).alias("items"))
            for name, kind, keys in MINUTES_LISTS
        ]
    )
    base = minutes_rows.withColumn("warning", F.lit(None).cast("string"))
    long = each(base.withColumn("_l", F.explode_outer(lists)), "_l.items", "*", item="item", pos="_p")
    summary = F.coalesce(*[F.when(F.col("_l.kind") == kind, _first_value(F.col("item"), keys)) for _, kind, keys in MINUTES_LISTS])
    long = long.withColumn("_summary", summary).filter("_summary <> ''").withColumn("_kind", F.col("_l.kind")).withColumn("_list", F.col("_l.list"))
    shared = F.coalesce(F.col("topic"), F.col("agenda"), F.col("section_title"))

    def refs(kind: Column) -> Column:
        return _ref(source_type=F.lit("minutes"), document_type=F.col("document_type"), source_file=F.col("source_file"), agenda=F.col("agenda"), section_title=F.col("section_title"), item_type=kind)

    listed = _event(
        long, F.col("_kind"), F.coalesce(blank_to_null(_first_value(F.col("item"), ["topic"])), shared), F.col("_summary"), refs(F.col("_list")),
        F.concat_ws(":", "section_title", "_list", (F.col("_p") + 1).cast("string")),
    )
    talk = base.filter("discussion is not null").withColumn("item", F.array().cast(ITEM))
    short = F.regexp_replace("discussion", rf"(?U){SPACE}+", " ")
    short = strip(short)
    discussed = _event(talk, F.lit("discussion"), shared, short, refs(F.lit("discussion")), F.concat(F.col("section_title"), F.lit(":discussion")))
    return listed.unionByName(discussed)


def explicit_events(meetings: DataFrame) -> DataFrame:
    """Events listed under ``# meeting_events`` in the minutes."""
    docs = accepted(meetings).filter("document_type = 'meeting_minutes'")
    listed = F.regexp_extract(F.concat(F.lit("\n"), "body"), r"(?s)\n#[ \t]+meeting_events[ \t]*\n(.*)", 1)
    rows = each(docs.withColumn("warning", F.lit(None).cast("string")), list_items(listed), "*", item="item", pos="_p")
    rows = rows.withColumn("_kind", F.lower(unquote(F.coalesce(entry_value(F.col("item"), "event_type"), F.lit(""))))).filter(F.col("_kind").isin(EVENT_TYPES))
    rows = rows.withColumn("_summary", _first_value(F.col("item"), ["event_summary", "summary", "text"])).filter("_summary <> ''")
    refs = _ref(
        source_type=F.lit("minutes"), document_type=F.col("document_type"), source_file=F.col("source_file"),
        section_title=null_if_blank(F.coalesce(entry_value(F.col("item"), "source_section"), F.lit(""))), item_type=F.col("_kind"),
    )
    return _event(rows, F.col("_kind"), _first_value(F.col("item"), ["topic"]), F.col("_summary"), refs, F.concat(F.lit("explicit:"), (F.col("_p") + 1).cast("string")))


def meeting_events(meetings: DataFrame) -> DataFrame:
    """All events; a document's explicit list replaces the derived ones."""
    explicit = explicit_events(meetings)
    derived = minutes_events(minutes_sections(meetings)).join(explicit.select("markdown_file").distinct(), "markdown_file", "left_anti")
    return slide_events(slides(meetings)).unionByName(explicit).unionByName(derived)


# ---------------------------------------------------------------- passages


def _labelled(pairs: list[tuple[str, Column]]) -> Column:
    blocks = F.array(*[F.when(~is_blank(v), F.concat(F.lit(f"## {k}\n"), unquote(v))) for k, v in pairs])
    return F.array_join(F.array_compact(blocks), "\n\n")


def _listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), F.to_json(entries_to_map(F.array_sort(i))))), "\n")


def _children(parents: DataFrame, fields: list[tuple[str, Column]]) -> DataFrame:
    named = F.array(*[F.struct(F.lit(k).alias("content_type"), F.lit(i).alias("no"), unquote(F.coalesce(v, F.lit(""))).alias("value")) for i, (k, v) in enumerate(fields, 1)])
    rows = parents.withColumn("_f", F.explode(F.filter(named, lambda f: ~f["value"].isin(BLANK_WORDS))))
    text = F.concat(F.col("_f.content_type"), F.lit("\n"), F.col("_f.value"))
    return rows.select(
        content_id("parent_id", F.col("_f.content_type"), F.col("_f.no").cast("string"), F.substring(text, 1, 120)).alias("child_id"), "parent_id", "corpus_id",
        "meeting_id", "source_file", "title", F.concat("heading_path", F.lit(" > "), F.col("_f.content_type")).alias("heading_path"),
        F.col("_f.content_type").alias("content_type"), text.alias("text"), "search_tags", "source_type",
    )


def _tag_lines() -> Column:
    return F.array_join(F.transform("search_tags", lambda t: F.concat(F.lit("- "), t)), "\n")


def slide_passages(slide_rows: DataFrame, corpus_id: str) -> tuple[DataFrame, DataFrame]:
    """Parent text and field-wise children of slides."""
    body = ["visible_text", "tables_markdown", "figures_and_charts", "visual_summary", "speaker_notes"]
    number = F.col("slide_no").cast("string")
    label = F.concat(F.lit("Slide "), number, F.lit(": "), F.col("slide_title"))
    parents = slide_rows.withColumns(
        {
            "corpus_id": F.lit(corpus_id),
            "source_type": F.lit("slide"),
            "parent_id": content_id(F.lit(corpus_id), "markdown_file", F.lit("slide"), number, "slide_title"),
            "title": strip(F.concat_ws(" ", "meeting_name", label)),
            "heading_path": strip(F.concat_ws(" > ", "meeting_name", label)),
            "text": _labelled([(k, F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in ["meeting_name", "meeting_date", "source_file", "slide_no", "slide_title", "agenda", "section", *body]]),
        }
    )
    fields = [("slide_title", F.col("slide_title")), *[(k, F.col(k)) for k in body], ("proposed_events", _listed(F.col("proposed_events"))), ("search_tags", _tag_lines())]
    return parents, _children(parents, fields)


def minutes_passages(minutes_rows: DataFrame, corpus_id: str) -> tuple[DataFrame, DataFrame]:
    """Parent text and field-wise children of minutes sections."""
    lists = [name for name, _, _ in MINUTES_LISTS]
    values = {k: F.col(k) for k in ("meeting_name", "meeting_date", "source_file", "agenda", "topic", "explanation", "discussion")} | {k: _listed(F.col(k)) for k in lists}
    parents = minutes_rows.withColumns(
        {
            "corpus_id": F.lit(corpus_id),
            "source_type": F.lit("minutes"),
            "parent_id": content_id(F.lit(corpus_id), "markdown_file", F.lit("minutes"), "section_title", F.coalesce("topic", F.lit(""))),
            "title": strip(F.concat_ws(" ", "meeting_name", "section_title")),
            "heading_path": strip(F.concat_ws(" > ", "meeting_name", "section_title")),
            "text": _labelled([(k, F.coalesce(v, F.lit(""))) for k, v in values.items()]),
        }
    )
    fields = [(k, values[k]) for k in ("explanation", "discussion", *lists)] + [("search_tags", _tag_lines())]
    return parents, _children(parents, fields)


# ---------------------------------------------------------------- timeline


def event_store(events: DataFrame, order: list[str]) -> DataFrame:
    """Events with an id, first occurrence of each."""
    return dedupe_first(events, "event_id", order)


def event_date() -> Column:
    return F.coalesce(blank_to_null("event_date"), F.col("meeting_date"), F.lit(""))


def timeline_keys() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("event_date", "meeting_date", "meeting_id", "event_id")]


def query_events(
    events: DataFrame, meeting_ids: list[str] | None = None, topic: str | None = None, event_type: str | None = None, date_from: str | None = None,
    date_to: str | None = None, status: str | None = None, owner: str | None = None, source_type: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Matching events in timeline order; a blank date passes the range."""
    rows, day = events, event_date()

    def contains(value: Column, word: str) -> Column:
        return F.contains(casefold(value), F.lit(word.strip().casefold()))

    if meeting_ids:
        rows = rows.filter(F.col("meeting_id").isin(meeting_ids))
    if event_type:
        rows = rows.filter(F.col("event_type") == event_type)
    if date_from:
        rows = rows.filter((day == "") | (day >= date_from))
    if date_to:
        rows = rows.filter((day == "") | (day <= date_to))
    if topic and topic.strip():
        names = [c for c in ("topic", "subtopic", "event_summary", "meeting_name") if c in events.columns]
        rows = rows.filter(contains(F.concat_ws("\n", *[text_or_empty(c) for c in names]), topic))
    if status and status.strip():
        rows = rows.filter(contains(text_or_empty("status"), status))
    if owner and owner.strip():
        rows = rows.filter(contains(text_or_empty("owner"), owner))
    if source_type and source_type.strip():
        wanted = source_type.strip().casefold()
        rows = rows.filter(F.exists("source_refs", lambda r: F.lower(text_or_empty(r["source_type"])) == wanted))
    ordered = rows.orderBy(*timeline_keys())
    return ordered if limit is None else ordered.limit(max(0, limit))


def current_state(events: DataFrame, group: str) -> DataFrame:
    """Latest state-changing event of each group, else its latest event."""
    order = F.struct(*timeline_keys())
    state = F.col("event_type").isin(STATE_TYPES)
    picked = F.struct("event_id", "event_type", "event_summary", event_date().alias("event_date"))
    best = events.groupBy(group).agg(F.max_by(F.when(state, picked), F.when(state, order)).alias("_s"), F.max_by(picked, order).alias("_l"))
    return best.select(group, F.coalesce("_s", "_l").alias("_e"), F.col("_s").isNotNull().alias("is_state")).select(group, "_e.*", "is_state")


def is_done(status) -> Column:
    return F.lower(strip(text_or_empty(status))).isin(DONE_WORDS)


def open_items(events: DataFrame) -> DataFrame:
    """Action items and pending points that are not done."""
    return events.filter(F.col("event_type").isin("action_item", "pending") & ~is_done("status"))


def source_label(refs="source_refs", event_id="event_id") -> Column:
    r = F.get(col(refs), F.lit(0))
    file = text_or_empty(r["source_file"])
    slide = F.concat(file, F.lit(" / Slide "), F.coalesce(r["slide_no"].cast("string"), F.lit("None")), F.lit(": "), F.coalesce(r["slide_title"], F.lit("None")))
    notes = F.concat_ws(" / ", file, text_or_empty(r["agenda"]), text_or_empty(r["section_title"]), text_or_empty(r["item_type"]))
    return F.when(r["source_type"] == "slide", slide).when(r["source_type"] == "minutes", notes).otherwise(F.coalesce(blank_to_null(file), text_or_empty(event_id)))


def timeline_rows(events: DataFrame) -> DataFrame:
    """Markdown table row and evidence label of each event, in order columns."""
    return events.select(
        *[k.alias(f"order_{i}") for i, k in enumerate(timeline_keys(), 1)],
        table_row(event_date(), "meeting_name", "event_type", "topic", "event_summary", "owner", "due_date", source_label()).alias("table_row"),
        source_label().alias("evidence"),
    )


# The wording of the report on a timeline.
REPORT_HEADS = ["## 1. 時系列サマリ", "## 2. 詳細タイムライン表", "## 3. 現在の状態", "## 4. 未完了事項・宿題", "## 5. 根拠一覧"]
REPORT_TABLE = "| 日付 | 会議名 | 種別 | トピック | 内容 | 担当 | 期限 | 根拠 |\n|---|---|---|---|---|---|---|---|"
REPORT_COUNT = "件のMeetingEventをevent_date、meeting_dateの昇順で整理しました。"
REPORT_STATE = ("時点では、", " と記録されています。")
REPORT_LATEST = ("最新イベントは ", " の ", " です。")
REPORT_ITEM = (" (担当: ", " / 期限: ", ")")
REPORT_UNKNOWN = "未記載"
REPORT_NO_ITEMS = "確認できる未完了事項・宿題はありません。"
REPORT_NOTHING = ["該当するMeetingEventは見つかりませんでした。", REPORT_TABLE, "確認できません。", "確認できません。", "なし"]


def _report(parts: list[Column]) -> Column:
    joined = []
    for head, part in zip(REPORT_HEADS, parts):
        # the table stands one blank line before the next head, as all parts do
        joined.append(F.concat(F.lit(head + "\n"), part))
    return F.array_join(F.array(*joined), "\n\n")


def timeline_report(events: DataFrame, group: str, limit: int, groups: DataFrame | None = None) -> DataFrame:
    """(group, n, report): one text in five parts about the first ``limit`` events of each group.

    Groups named in ``groups`` that have no event get the report that says so.
    """
    order = Window.partitionBy(group).orderBy(*timeline_keys())
    # the limit is the report's length: what is gathered per group is bounded by it
    few = events.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positive(limit))

    def word(value) -> Column:
        return F.coalesce(blank_to_null(text_or_empty(value)), F.lit(REPORT_UNKNOWN))

    when, summary = event_date(), text_or_empty("event_summary")
    state = F.when(F.col("event_type").isin(STATE_TYPES), F.concat(when, F.lit(REPORT_STATE[0]), summary, F.lit(REPORT_STATE[1])))
    last = F.concat(F.lit(REPORT_LATEST[0]), when, F.lit(REPORT_LATEST[1]), summary, F.lit(REPORT_LATEST[2]))
    undone = F.col("event_type").isin("action_item", "pending") & ~is_done("status")
    item = F.when(undone, F.concat(F.lit("- "), when, F.lit(": "), summary, F.lit(REPORT_ITEM[0]), word("owner"), F.lit(REPORT_ITEM[1]), word("due_date"), F.lit(REPORT_ITEM[2])))
    line = table_row(when, "meeting_name", "event_type", "topic", "event_summary", "owner", "due_date", source_label())
    rows = few.select(group, "_n", line.alias("line"), state.alias("state"), last.alias("last"), item.alias("item"), F.concat(F.lit("- "), source_label()).alias("evidence"))
    gathered = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("_n", "line", "item", "evidence"))).alias("e"),
        F.max_by("state", F.when(F.col("state").isNotNull(), F.col("_n"))).alias("state"), F.max_by("last", "_n").alias("last"),
    )
    items = F.array_join(F.filter(F.col("e")["item"], lambda x: x.isNotNull()), "\n")
    report = _report([
        F.concat(F.col("n").cast("string"), F.lit(REPORT_COUNT)), F.concat(F.lit(REPORT_TABLE + "\n"), F.array_join(F.col("e")["line"], "\n")),
        F.coalesce("state", "last"), F.coalesce(blank_to_null(items), F.lit(REPORT_NO_ITEMS)), F.array_join(F.col("e")["evidence"], "\n"),
    ])
    out = gathered.select(group, "n", report.alias("report"))
    if groups is None:
        return out
    nothing = _report([F.lit(t) for t in REPORT_NOTHING])
    missing = groups.select(group).distinct().join(out.select(group), group, "left_anti")
    return out.unionByName(missing.select(group, F.lit(0).cast("long").alias("n"), nothing.alias("report")))


def event_sources(events: DataFrame) -> DataFrame:
    """Events as source rows for logging and prompts."""
    r = F.get(F.col("source_refs"), F.lit(0))
    return events.select(
        F.lit("meeting_events").alias("corpus_id"), F.col("event_id").alias("parent_id"), F.concat("event_id", F.lit(":event")).alias("child_id"),
        F.col("meeting_name").alias("title"), F.concat(text_or_empty("topic"), F.lit(" > "), text_or_empty("event_type")).alias("heading_path"),
        text_or_empty("event_summary").alias("child_text"), F.lit("").alias("parent_text"), F.lit(1.0).alias("score"), r["source_file"].alias("source_file"),
        r["source_type"].alias("source_type"), "meeting_id", "meeting_date", r["agenda"].alias("agenda"), "topic", r["section_title"].alias("section_title"),
        r["slide_no"].alias("slide_no"), r["slide_title"].alias("slide_title"), r["document_type"].alias("document_type"), "meeting_name",
        F.array().cast("array<string>").alias("search_tags"), F.array().cast("array<string>").alias("forms"),
    )


def timeline_intent(question) -> tuple[Column, Column, Column]:
    """(is a timeline question, event type asked for, topic left after removing the keywords)."""
    q = text_or_empty(question)

    def any_of(words: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(q, w))

    kind = F.coalesce(*[F.when(any_of(words), F.lit(name)) for name, words in TYPE_WORDS])
    rest = q
    for word in TIMELINE_WORDS + [w for _, words in TYPE_WORDS for w in words]:
        rest = F.replace(rest, F.lit(word), F.lit(" "))
    rest = strip(F.regexp_replace(F.regexp_replace(rest, "[?？。、「」『』についてを教えてください下さい]", " "), rf"(?U){SPACE}+", " "))
    return any_of(TIMELINE_WORDS), kind, F.when(F.length(rest) >= 2, rest)


def resolve_timelines(questions: DataFrame, seeds: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """Events per timeline question: those of its seed meetings, else by topic, else by type alone.

    ``questions`` has (query_id, question), ``seeds`` (query_id, meeting_id).  Each question
    gets its first ``limit`` events.
    """
    asked, kind, topic = timeline_intent("question")
    q = questions.select("query_id", asked.alias("_asked"), kind.alias("_kind"), topic.alias("_topic")).filter("_asked").drop("_asked")
    meetings = seeds.filter(F.coalesce("meeting_id", F.lit("")) != "").select("query_id", "meeting_id").distinct()
    e = events.withColumn("_hay", casefold(F.concat_ws("\n", text_or_empty("topic"), text_or_empty("subtopic"), text_or_empty("event_summary"), text_or_empty("meeting_name"))))
    fits = F.col("_kind").isNull() | (F.col("_kind") == F.col("event_type"))
    columns = ["query_id", *events.columns]
    seeded = q.join(meetings, "query_id").join(e, "meeting_id").filter(fits).select(*columns)
    free = q.join(meetings.select("query_id").distinct(), "query_id", "left_anti")
    # topics meet events through the topics each event text contains
    folded = free.withColumn("_t", casefold("_topic"))
    found = contained_terms(e, "event_id", "_hay", folded.select(F.col("_t").alias("term")))
    by_topic = folded.filter("_t is not null").join(found.withColumnRenamed("term", "_t"), "_t").join(e, "event_id").filter(fits).select(*columns)
    rest = free.join(by_topic.select("query_id").distinct(), "query_id", "left_anti")
    # questions without a usable topic share the first `limit` events of their type, or of all
    per_type = Window.partitionBy("event_type").orderBy(*timeline_keys())
    pool = e.withColumn("_n", F.row_number().over(per_type)).filter(F.col("_n") <= limit).withColumnRenamed("event_type", "_et")
    typed = rest.filter("_kind is not null").join(pool, F.col("_kind") == F.col("_et")).withColumnRenamed("_et", "event_type").select(*columns)
    first = e.orderBy(*timeline_keys()).limit(limit).withColumn("_all", F.lit(True))
    untyped = rest.filter("_kind is null").withColumn("_all", F.lit(True)).join(F.broadcast(first), "_all").select(*columns)
    typed = typed.unionByName(untyped)
    out = seeded.unionByName(by_topic).unionByName(typed)
    w = Window.partitionBy("query_id").orderBy(*timeline_keys())
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


