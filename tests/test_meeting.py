from pyspark.sql import functions as F

from corpusloom.operators import meeting as M

SLIDES = """---
document_type: meeting_slide_deck
meeting_id: m1
meeting_name: Board
meeting_date: "2024-04-01"
source_file: deck.pptx
---

# Slide 1: Plan

## slide_metadata
- slide_no: 1
- slide_title: "Plan A"
- agenda: Budget

## visible_text
Numbers here

## speaker_notes
なし

## proposed_events
- event_type: decision
  summary: Adopt plan A
  owner: Kim
- event_type: none
- Loose idea

## search_tags
- budget、plan
- budget
"""
MINUTES = """<!-- exported -->
---
document_type: meeting_minutes
meeting_id: m1
meeting_name: Board
meeting_date: 2024-04-02
source_file: notes.docx
---

# meeting_overview
skip

# 議題1: Budget

## section_metadata
agenda: Budget
topic: Plan

## discussion
Long   talk
about it

## decisions
- decision: Approve
  event_date: 2024-04-05
- なし

## action_items
- task: Send report
  担当: Lee
  期限: 2024-05-01
  status: done
- task: Call bank
  more words

## concerns
なし
"""
EXPLICIT = MINUTES.replace("source_file: notes.docx", "source_file: other.docx") + "\n# meeting_events\n- event_type: completion\n  event_summary: Done\n  topic: T\n- event_type: odd\n  event_summary: x\n"


def parsed(spark):
    files = [
        ("s.md", SLIDES), ("n.md", MINUTES), ("e.md", EXPLICIT), ("bad.md", "---\ndocument_type: memo\n---\nx"), ("blank.md", MINUTES.replace("2024-04-02", '""')), ("noid.md", SLIDES.replace("meeting_id: m1", "meeting_id:")),
    ]
    return M.parse_meetings(spark.createDataFrame(files, "source_file string, text string"))


def test_validation(spark):
    rows = {r.markdown_file: r for r in parsed(spark).collect()}
    assert rows["bad.md"].errors == ["unsupported document_type: memo"] and rows["blank.md"].errors == ["blank.md: meeting_date is required"]
    assert rows["noid.md"].warnings == ["noid.md: meeting_id is missing"] and rows["s.md"].errors == [] and rows["n.md"].meeting_date == "2024-04-02"
    assert M.quarantined(parsed(spark)).count() == 2


def test_records_and_links(spark):
    p = parsed(spark)
    slide = M.slides(p).filter("markdown_file = 's.md'").first()
    assert (slide.slide_no, slide.slide_title, slide.agenda, slide.visible_text, slide.speaker_notes, slide.search_tags) == (1, "Plan A", "Budget", "Numbers here", None, ["budget", "plan"])
    section = M.minutes_sections(p).filter("markdown_file = 'n.md'").first()
    assert section.section_title == "議題1: Budget" and section.topic == "Plan" and len(section.decisions) == 1 and len(section.action_items) == 2 and section.concerns == []
    assert {e.key: e.value for e in section.action_items[1]} == {"task": "Call bank", "text": "more words"}
    assert M.slides_with_minutes(M.slides(p), M.minutes_sections(p)).filter("slide_title = 'Plan A'").count() == 2


def test_events(spark):
    events = M.meeting_events(parsed(spark)).collect()
    slide = [e for e in events if e.markdown_file == "s.md"]
    assert sorted((e.event_type, e.event_summary, e.owner) for e in slide) == [("proposal", "Adopt plan A", "Kim"), ("proposal", "Loose idea", None)]
    assert [e.warning for e in slide if e.event_summary == "Adopt plan A"] == ["deck.pptx slide 1: proposed event was downgraded from decision to proposal"]
    notes = {e.event_summary: e for e in events if e.markdown_file == "n.md"}
    assert set(notes) == {"Approve", "Send report", "Call bank", "Long talk about it"}
    assert notes["Approve"].event_date == "2024-04-05" and notes["Send report"].owner == "Lee" and notes["Send report"].due_date == "2024-05-01" and notes["Send report"].topic == "Plan"
    assert [(e.event_type, e.event_summary) for e in events if e.markdown_file == "e.md"] == [("completion", "Done")]
    assert len({e.event_id for e in events}) == len(events)


def test_passages(spark):
    p = parsed(spark)
    parents, kids = M.slide_passages(M.slides(p).filter("markdown_file = 's.md'"), "c")
    assert "## slide_title\nPlan A" in parents.first().text and "speaker_notes" not in parents.first().text
    assert sorted(k.content_type for k in kids.collect()) == ["proposed_events", "search_tags", "slide_title", "visible_text"]
    _, kids = M.minutes_passages(M.minutes_sections(p).filter("markdown_file = 'n.md'"), "c")
    assert sorted(k.content_type for k in kids.collect()) == ["action_items", "decisions", "discussion"]


def test_timeline(spark):
    p = parsed(spark)
    events = M.event_store(M.meeting_events(p), ["event_date", "event_id"])
    assert [r.event_summary for r in M.query_events(events, event_type="action_item", owner="lee").collect()] == ["Send report"]
    assert [r.event_summary for r in M.open_items(events).collect()] == ["Call bank"]
    state = M.current_state(events.filter("meeting_id = 'm1'"), "meeting_id").first()
    assert (state.event_summary, state.event_date) == ("Approve", "2024-04-05")
    labels = {r.evidence for r in M.timeline_rows(events).collect()}
    assert "deck.pptx / Slide 1: Plan A" in labels and "notes.docx / Budget / 議題1: Budget / decisions" in labels
    assert M.event_sources(events).filter("source_type = 'minutes'").first().corpus_id == "meeting_events"


def test_questions(spark):
    events = M.event_store(M.meeting_events(parsed(spark)), ["event_date", "event_id"])
    q = spark.createDataFrame([(1, "Planの経緯を教えてください"), (2, "決定事項だけ"), (3, "普通の質問"), (4, "時系列")], "query_id long, question string")
    intent = q.select("query_id", *[c.alias(n) for c, n in zip(M.timeline_intent("question"), ("asked", "kind", "topic"))]).collect()
    assert [(r.asked, r.kind, r.topic) for r in intent] == [(True, None, "Planの"), (True, "decision", None), (False, None, "普通の質問"), (True, None, None)]
    seeds = spark.createDataFrame([(4, "m1")], "query_id long, meeting_id string")
    got = {}
    for r in M.resolve_timelines(q, seeds, events, 120).collect():
        got.setdefault(r.query_id, []).append(r.event_type)
    assert set(got) == {1, 2, 4} and set(got[2]) == {"decision"} and len(got[4]) == events.filter("meeting_id = 'm1'").count()
    assert F.lit(1) is not None
