"""Search tags: rule-based tags, normalisation, tag search and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import col, search_text, squeeze, strip, text_or_empty
from corpusloom.functions.unicode import casefold
from corpusloom.functions.values import fenced_json, json_strings
from corpusloom.operators.matching import contained_terms

# Metadata fields whose values are tags.
META_TAG_KEYS = ["document_type", "document_id", "tsutatsu_name", "tax_type", "asset_tax_category", "category"]

# Dictionary of domain terms in their tag order.
TERMS = [
    "相続税", "贈与税", "財産評価", "財産の評価", "譲渡所得", "所得税", "相続", "遺贈", "贈与", "被相続人",
    "相続人", "受贈者", "法定相続人", "基礎控除", "相続時精算課税", "暦年課税", "小規模宅地等の特例", "配偶者控除",
    "税額控除", "申告期限", "納税", "延納", "物納", "死亡保険金", "死亡退職金", "債務控除", "葬式費用", "土地評価",
    "家屋評価", "宅地評価", "路線価方式", "倍率方式", "借地権", "貸家建付地", "農地", "山林", "非上場株式", "株式評価",
    "取得費", "譲渡費用", "譲渡収入", "長期譲渡所得", "短期譲渡所得", "分離課税", "居住用財産", "空き家特例",
    "国外転出時課税", "非居住者", "取得時期", "関連コード", "根拠法令等", "通達", "基本通達", "法令解釈通達",
    "相続税法基本通達", "財産評価基本通達", "評価通達", "租税特別措置法", "措置法", "措置法通達", "小規模宅地等",
    "事業承継税制", "農地等", "非上場株式等", "情報PDF", "税解釈", "質疑応答", "質疑応答事例", "照会要旨", "回答要旨",
    "回答", "事例", "令和", "税制改正", "あらまし",
]
# Tags implied by a folder or corpus name.
CATEGORY_TAGS = {
    "01_inheritance_tax": ["相続税", "相続", "遺産", "被相続人"],
    "02_gift_tax": ["贈与税", "贈与", "受贈者"],
    "03_property_valuation": ["財産評価", "財産の評価", "評価"],
    "04_transfer_income": ["譲渡所得", "所得税", "資産譲渡"],
    "05_related_income_tax": ["所得税", "相続・贈与関連所得税"],
    "nta_sozoku_kihon_tsutatsu": ["相続税法基本通達", "相続税", "基本通達", "法令解釈通達"],
    "nta_zaisan_hyoka_kihon_tsutatsu": ["財産評価基本通達", "財産評価", "評価通達", "法令解釈通達"],
    "nta_sozoku_sochiho_tsutatsu": ["租税特別措置法", "措置法通達", "相続税", "特例", "法令解釈通達"],
    "nta_sozoku_joho_zeikaishaku_pdf": ["相続税・贈与税関係情報PDF", "情報PDF", "税解釈", "相続税", "贈与税"],
    "nta_sozoku_shitsugi": ["質疑応答事例", "相続税", "贈与税", "照会要旨", "回答要旨"],
}


def _empty() -> Column:
    return F.array().cast("array<string>")


def usable_tags(values: Column) -> Column:
    """Squeezed, not blank, not only signs; distinct in first-seen order."""
    clean = F.transform(values, lambda v: squeeze(v))
    return F.array_distinct(F.filter(clean, lambda v: (v != "") & ~F.rlike(v, F.lit(r"(?U)^[\W_]+$"))))


def code_tags(text) -> Column:
    """``code``, ``No.code`` and ``コードcode`` for article codes of three or more digits."""
    t = text_or_empty(text)
    patterns = [r"(?U)TaxAnswer No\.\s*:\s*([0-9０-９-]+)", r"No\.([0-9０-９-]+)", r"(?U)コード\s*([0-9０-９-]+)"]
    raw = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns])
    codes = F.filter(F.transform(raw, lambda c: F.translate(c, "０１２３４５６７８９", "0123456789")), lambda c: F.length(F.replace(c, F.lit("-"), F.lit(""))) >= 3)
    return F.array_distinct(F.flatten(F.transform(codes, lambda c: F.array(c, F.concat(F.lit("No."), c), F.concat(F.lit("コード"), c)))))


def title_phrases(title) -> Column:
    """The title without numbering, and its parts of 2 to 30 characters."""
    t = F.regexp_replace(text_or_empty(title), "^[0-9-]+_", "")
    t = F.replace(F.regexp_replace(t, r"(?U)^No\.[0-9-]+\s*", ""), F.lit("_"), F.lit(" "))
    parts = F.filter(F.split(t, r"(?U)[、。・（）()\[\]「」『』\s]+", -1), lambda p: F.length(p).between(2, 30))
    return usable_tags(F.concat(F.array(t), parts))


def category_tags(source_file, corpus_id, categories: dict[str, list[str]] = CATEGORY_TAGS) -> Column:
    file, corpus = text_or_empty(source_file), text_or_empty(corpus_id)
    groups = [
        F.when(F.contains(file, F.lit(key)) | (corpus == key), F.array(*[F.lit(v) for v in values])).otherwise(_empty())
        for key, values in categories.items()
    ]
    return F.array_distinct(F.concat(*groups)) if groups else _empty()


def rule_tags(children: DataFrame, terms: list[str] | None = None, categories: dict[str, list[str]] | None = None, meta_keys: list[str] = META_TAG_KEYS, limit: int | None = None) -> DataFrame:
    """Add ``search_tags``: category, metadata, code, title and dictionary tags in that order.

    The dictionary is part of the expression, so tagging is one projection without a
    join; use :func:`dictionary_tags` for dictionaries too large for that.
    """
    terms = TERMS if terms is None else terms
    categories = CATEGORY_TAGS if categories is None else categories
    hay = F.concat_ws("\n", *[text_or_empty(c) for c in ("title", "heading_path", "source_file", "text")])
    meta = F.array_compact(F.array(*[F.col(k).cast("string") for k in meta_keys if k in children.columns])) if any(k in children.columns for k in meta_keys) else _empty()
    found = F.filter(F.array(*[F.lit(t) for t in dict.fromkeys(terms)]), lambda t: F.contains(F.col("_hay"), t)) if terms else _empty()
    tags = F.concat(category_tags("source_file", "corpus_id", categories), usable_tags(meta), usable_tags(code_tags("_hay")), title_phrases("title"), found)
    return children.withColumn("_hay", hay).withColumn("search_tags", _first(F.array_distinct(tags), limit)).drop("_hay")


def dictionary_tags(children: DataFrame, terms: DataFrame, key: str = "child_id", text: str = "text") -> DataFrame:
    """(key, tags): contained terms of a dictionary table, in name order."""
    hits = contained_terms(children, key, text, terms)
    # a text's distinct dictionary terms: bounded by the text itself
    return hits.groupBy(key).agg(F.sort_array(F.collect_set("term")).alias("tags"))


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def normalize_tags(values, limit: int | None = None) -> Column:
    """Squeezed distinct tags, cut to ``limit`` if there is one."""
    clean = F.filter(F.transform(col(values), squeeze), lambda t: t != "")
    return _first(F.array_distinct(clean), limit)


def edited_tags(values, limit: int | None = None) -> Column:
    """Tags typed by an editor: split on commas and line breaks, distinct, cut to ``limit`` if there is one."""
    parts = F.flatten(F.transform(col(values), lambda v: F.split(v, "[,、，\r\n]", -1)))
    return _first(F.array_distinct(F.filter(F.transform(parts, strip), lambda t: t != "")), limit)


def with_tags(children: DataFrame, tags: Column) -> DataFrame:
    """Set the tags and rebuild the search text."""
    return children.withColumn("search_tags", tags).withColumn("search_text", search_text("title", "heading_path", "text", "search_tags"))


def apply_tag_edits(children: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace tags of edited children (child_id, search_tags) and rebuild their search text."""
    new = edits.select("child_id", edited_tags("search_tags").alias("_new"))
    joined = children.join(new, "child_id", "left")
    tags = F.coalesce("_new", "search_tags")
    rebuilt = search_text("title", "heading_path", "text", tags)
    text = F.when(F.col("_new").isNotNull(), rebuilt).otherwise(F.col("search_text")) if "search_text" in children.columns else rebuilt
    return joined.withColumn("search_text", text).withColumn("search_tags", tags).drop("_new").select(*children.columns, *([] if "search_text" in children.columns else ["search_text"]))


def parse_model_tags(reply, limit: int | None = None) -> Column:
    """Tags from a model reply: JSON array, possibly fenced; unreadable replies give none."""
    return normalize_tags(json_strings(fenced_json(reply)), limit)


def pending_tags(children: DataFrame, done: DataFrame) -> DataFrame:
    """Children without a completed tag row (tags and search text present, no error)."""
    complete = done.filter(F.col("search_tags").isNotNull() & (F.coalesce("search_text", F.lit("")) != "") & (F.coalesce("tag_error", F.lit("")) == ""))
    return children.join(complete.select("child_id"), "child_id", "left_anti")


def resume_tags(children: DataFrame, done: DataFrame, tag) -> DataFrame:
    """Tag the pending children and keep completed rows.

    ``tag`` maps pending children to (child_id, reply, tag_error); failures get no tags
    and carry the error.
    """
    pending = pending_tags(children, done)
    replies = tag(pending).select("child_id", "reply", F.col("tag_error").alias("_err"))
    fresh = pending.drop("search_tags", "search_text", "tag_error").join(replies, "child_id", "left")
    failed = F.coalesce("_err", F.lit("")) != ""
    tags = F.when(failed, _empty()).otherwise(parse_model_tags("reply"))
    fresh = with_tags(fresh, tags).withColumn("tag_error", F.col("_err")).drop("reply", "_err")
    reused = done.join(children.select("child_id"), "child_id", "left_semi").join(pending.select("child_id"), "child_id", "left_anti")
    return fresh.unionByName(reused, allowMissingColumns=True)


TAG_SEARCH_FIELDS = ["child_id", "parent_id", "corpus_id", "title", "heading_path", "source_file", "source_url", "text"]


def search_tags(children: DataFrame, query: str | None = None, corpus_id: str | None = None) -> DataFrame:
    """Children of a corpus whose fields or tags contain the query."""
    rows = children.filter(F.col("corpus_id") == corpus_id) if corpus_id else children
    if query and query.strip():
        parts = [text_or_empty(c) for c in TAG_SEARCH_FIELDS if c in children.columns] + [F.array_join("search_tags", " ")]
        rows = rows.filter(F.contains(casefold(F.concat_ws("\n", *parts)), F.lit(query.strip().casefold())))
    cut = F.when(F.length("text") > 240, F.concat(F.substring("text", 1, 240), F.lit("..."))).otherwise(F.col("text"))
    return rows.withColumn("tag_count", F.size("search_tags")).withColumn("text_preview", cut)


def tag_candidates(children: DataFrame, weak_logs: DataFrame, top_n: int | None = None, few: int = 2) -> DataFrame:
    """Children used by low-confidence answers, then children with few tags; cut to ``top_n`` if given."""
    failed = weak_logs.select(F.explode("sources").alias("s")).select(F.col("s.child_id").alias("child_id")).filter("child_id <> ''").distinct()
    marked = children.join(failed.withColumn("_failed", F.lit(True)), "child_id", "left")
    reason = F.when(F.col("_failed"), "used_by_low_confidence_answer").when(F.size(F.coalesce("search_tags", _empty())) <= few, "few_tags")
    ordered = marked.withColumn("candidate_reason", reason).drop("_failed").filter("candidate_reason is not null").orderBy(F.col("candidate_reason").desc(), "child_id")
    return ordered if top_n is None else ordered.limit(top_n)


