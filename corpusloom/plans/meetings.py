"""Meeting events and timelines: every row of ``events`` is one meeting event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import meeting as M
from corpusloom.operators import ranking as R
from corpusloom.plans.catalog import ctes, load, query

MEETING = """me AS (SELECT 'e' || event_id AS event_id, 'm' || user_id % 60 AS meeting_id, 'Meeting ' || user_id % 7 AS meeting_name, strftime(ts, '%Y-%m-%d') AS meeting_date,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d') END AS event_date, 'Topic ' || regexp_extract(props, '(\\d+)', 1)::BIGINT % 12 AS topic,
    CASE event_type WHEN 'click' THEN 'discussion' WHEN 'view' THEN 'decision' WHEN 'error' THEN 'action_item' WHEN 'signup' THEN 'pending' ELSE 'report' END AS event_type,
    'Summary ' || event_id % 100 AS event_summary, 'Owner ' || user_id % 5 AS owner, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN '完了' ELSE 'open' END AS status,
    CASE WHEN event_id % 2 = 0 THEN 'slide' ELSE 'minutes' END AS source_type FROM events)"""
KEYS = "event_date, meeting_date, meeting_id, event_id"


def meeting_events(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")

    def name(prefix: str, number):
        return F.concat(F.lit(prefix), number.cast("string"))

    kind = F.col("event_type")
    none = F.lit(None).cast("string")
    ref = F.struct(
        F.when(n % 2 == 0, "slide").otherwise("minutes").alias("source_type"), none.alias("document_type"), F.lit("f.md").alias("source_file"), none.alias("agenda"),
        none.alias("section_title"), F.lit(1).alias("slide_no"), F.lit("s").alias("slide_title"), none.alias("item_type"),
    )
    return e.select(
        name("e", n).alias("event_id"), name("m", u % 60).alias("meeting_id"), name("Meeting ", u % 7).alias("meeting_name"), F.date_format("ts", "yyyy-MM-dd").alias("meeting_date"),
        F.when(n % 5 == 0, "").otherwise(F.date_format(F.col("ts") + F.expr("INTERVAL 2 DAYS"), "yyyy-MM-dd")).alias("event_date"), name("Topic ", k % 12).alias("topic"), none.alias("subtopic"),
        F.when(kind == "click", "discussion").when(kind == "view", "decision").when(kind == "error", "action_item").when(kind == "signup", "pending").otherwise("report").alias("event_type"),
        name("Summary ", n % 100).alias("event_summary"), name("Owner ", u % 5).alias("owner"), F.lit("").alias("due_date"),
        F.when(n % 4 == 0, "done").when(n % 4 == 1, "完了").otherwise("open").alias("status"), F.array(ref).alias("source_refs"),
    )


@query("event_query", ctes(MEETING) + f"""SELECT event_id, meeting_id, event_date, topic FROM me WHERE event_type = 'decision' AND (coalesce(nullif(event_date, ''), meeting_date) BETWEEN '2024-01-05' AND '2024-01-20')
    AND contains(lower(topic || chr(10) || event_summary || chr(10) || meeting_name), 'topic 1') AND contains(status, 'open') AND source_type = 'slide' ORDER BY {KEYS} LIMIT 120""")
def event_query(spark, sf_dir):
    rows = M.query_events(meeting_events(spark, sf_dir), event_type="decision", date_from="2024-01-05", date_to="2024-01-20", topic="Topic 1", status="OPEN", source_type="slide", limit=120)
    return rows.select("event_id", "meeting_id", "event_date", "topic")


@query("timeline", ctes(MEETING) + f"SELECT event_id, row_number() OVER (PARTITION BY meeting_id ORDER BY {KEYS}) AS n FROM me")
def timeline(spark, sf_dir):
    return R.ordinal(meeting_events(spark, sf_dir).select("event_id", "meeting_id", "event_date", "meeting_date"), ["meeting_id"], ["event_date", "meeting_date", "event_id"], "n").select("event_id", "n")


@query("timeline_rows", ctes(MEETING) + """SELECT event_date AS order_1, meeting_date AS order_2, meeting_id AS order_3, event_id AS order_4, '| ' || coalesce(nullif(event_date, ''), meeting_date) || ' | ' || meeting_name || ' | ' || event_type || ' | ' || topic || ' | ' || event_summary
    || ' | ' || owner || ' |  | ' || CASE WHEN source_type = 'slide' THEN 'f.md / Slide 1: s' ELSE 'f.md /  /  /' END || ' |' AS table_row, CASE WHEN source_type = 'slide' THEN 'f.md / Slide 1: s' ELSE 'f.md /  /  / ' END AS evidence FROM me""")
def timeline_rows(spark, sf_dir):
    return M.timeline_rows(meeting_events(spark, sf_dir))


@query("current_state", ctes(MEETING) + f"""SELECT meeting_id, event_id, event_type, event_summary, coalesce(nullif(event_date, ''), meeting_date) AS event_date, event_type IN ('decision', 'change', 'completion', 'report') AS is_state FROM me
    QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY event_type IN ('decision', 'change', 'completion', 'report') DESC, me.event_date DESC, meeting_date DESC, event_id DESC) = 1""")
def current_state(spark, sf_dir):
    return M.current_state(meeting_events(spark, sf_dir), "meeting_id")


@query("open_items", ctes(MEETING) + "SELECT event_id, event_summary, owner FROM me WHERE event_type IN ('action_item', 'pending') AND status NOT IN ('done', '完了')")
def open_items(spark, sf_dir):
    return M.open_items(meeting_events(spark, sf_dir)).select("event_id", "event_summary", "owner")


_REPORT = f"""few AS (SELECT *, coalesce(nullif(event_date, ''), meeting_date) AS d, CASE WHEN source_type = 'slide' THEN 'f.md / Slide 1: s' ELSE 'f.md /  /  / ' END AS ev, trim(ev) AS cell,
        row_number() OVER (PARTITION BY meeting_id ORDER BY {KEYS}) AS n FROM me QUALIFY n <= 120),
    r AS (SELECT meeting_id, count(*) AS n, string_agg('| ' || d || ' | ' || meeting_name || ' | ' || event_type || ' | ' || topic || ' | ' || event_summary || ' | ' || owner || ' |  | ' || cell || ' |', chr(10) ORDER BY n) AS lines,
        arg_max(d || '時点では、' || event_summary || ' と記録されています。', n) FILTER (event_type IN ('decision', 'change', 'completion', 'report')) AS state, arg_max('最新イベントは ' || d || ' の ' || event_summary || ' です。', n) AS last,
        string_agg('- ' || d || ': ' || event_summary || ' (担当: ' || owner || ' / 期限: 未記載)', chr(10) ORDER BY n) FILTER (event_type IN ('action_item', 'pending') AND status NOT IN ('done', '完了')) AS items,
        string_agg('- ' || ev, chr(10) ORDER BY n) AS evidence FROM few GROUP BY meeting_id)"""


@query(
    "timeline_report",
    ctes(MEETING, _REPORT)
    + """SELECT meeting_id, n, '## 1. 時系列サマリ' || chr(10) || n || '件のMeetingEventをevent_date、meeting_dateの昇順で整理しました。' || chr(10) || chr(10) || '## 2. 詳細タイムライン表' || chr(10)
    || '| 日付 | 会議名 | 種別 | トピック | 内容 | 担当 | 期限 | 根拠 |' || chr(10) || '|---|---|---|---|---|---|---|---|' || chr(10) || lines || chr(10) || chr(10) || '## 3. 現在の状態' || chr(10) || coalesce(state, last) || chr(10) || chr(10)
    || '## 4. 未完了事項・宿題' || chr(10) || coalesce(items, '確認できる未完了事項・宿題はありません。') || chr(10) || chr(10) || '## 5. 根拠一覧' || chr(10) || evidence AS report FROM r""",
)
def timeline_report(spark, sf_dir):
    return M.timeline_report(meeting_events(spark, sf_dir), "meeting_id", 120)


@query("dedupe_first", "SELECT 'k' || user_id % 200 AS key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 200 ORDER BY ts, event_id) AS n FROM events WHERE user_id % 200 <> 0) WHERE n = 1")
def dedupe_first(spark, sf_dir):
    n = F.col("user_id") % 200
    rows = load(spark, sf_dir, "events").select(F.when(n == 0, "").otherwise(F.concat(F.lit("k"), n.cast("string"))).alias("key"), "event_id", "ts")
    return R.dedupe_first(rows, "key", ["ts", "event_id"]).select("key", "event_id")
