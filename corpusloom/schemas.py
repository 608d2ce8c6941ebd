"""Table schemas.  Optional columns are nullable; schemas are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

S, I, L, D, B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()
STRINGS, VECTOR = ArrayType(S), ArrayType(FloatType())


def table(**columns: T.DataType) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


CHUNKING = table(
    parent_split_levels=ArrayType(I), max_parent_chars=I, min_parent_chars=I, child_max_chars=I, child_overlap_chars=I,
    force_heading_split=B, auto_descend=B, chunking_mode=S,
)
SOURCE = table(
    corpus_id=S, parent_id=S, child_id=S, source_file=S, source_url=S, title=S, heading_path=S, document_type=S, document_id=S,
    taxanswer_no=S, score=D, child_text=S, parent_text=S, text=S,
)
EVIDENCE = table(corpus_id=S, parent_id=S, child_id=S, title=S, heading_path=S, source_file=S, child_text=S, score=D)
SOURCE_REF = table(source_type=S, document_type=S, source_file=S, agenda=S, section_title=S, slide_no=I, slide_title=S, item_type=S)

CORPORA = table(corpus_id=S, display_name=S, description=S, markdown_dir=S, priority=I, enabled=B, chunking=CHUNKING)
DOCUMENTS = table(corpus_id=S, source_file=S, text=S, meta=MapType(S, S))
PAGES = table(page_id=L, url=S, html=S)
LINKS = table(page_id=L, source_url=S, position=I, url=S, text=S, h2=S, h3=S)
PARENT_CHUNKS = table(
    parent_id=S, corpus_id=S, title=S, source_file=S, heading_path=S, text=S, chunking_method=S, parent_marker_id=S, marker_source=S, parent_no=I,
)
CHILD_CHUNKS = table(
    child_id=S, parent_id=S, corpus_id=S, title=S, source_file=S, source_url=S, heading_path=S, text=S, document_type=S, document_id=S, taxanswer_no=S,
    valid_from=S, valid_until=S, search_tags=STRINGS, search_text=S, tag_error=S,
)
VECTOR_INDEX = table(child_id=S, embedding=VECTOR, document=S, corpus_id=S, parent_id=S, title=S, source_file=S, heading_path=S, release_id=S)
RELEASES = table(release_id=S, status=S, collection_name=S, corpus_version=S, index_version=S, row_count=L, embedding_size=I, error=S)
ITEMS = ArrayType(ArrayType(table(key=S, value=S)))
SLIDES = table(
    meeting_id=S, meeting_name=S, meeting_date=S, source_file=S, slide_no=I, slide_title=S, agenda=S, section=S, visible_text=S, proposed_events=ITEMS, search_tags=STRINGS,
)
MEETING_EVENTS = table(
    event_id=S, meeting_id=S, meeting_name=S, meeting_date=S, event_date=S, topic=S, subtopic=S, event_type=S, event_summary=S, before_state=S,
    after_state=S, owner=S, due_date=S, status=S, source_refs=ArrayType(SOURCE_REF), confidence=D,
)
APPROVED_QA = table(
    id=L, created_at=S, updated_at=S, status=S, question=S, answer=S, embedding=VECTOR, evidence=ArrayType(EVIDENCE), corpus_version=S, index_version=S,
    approved_by=S, source_report_id=L, memo=S, needs_alias_review=B,
)
ALIASES = table(
    id=L, qa_id=L, created_at=S, updated_at=S, status=S, alias_text=S, normalized_text=S, alias_type=S, embedding=VECTOR, generator_model=S, memo=S, risk_flags=STRINGS,
)
REPORTS = table(
    id=L, created_at=S, updated_at=S, status=S, session_id=S, log_id=L, question=S, answer=S, comment=S, resolved_qa_id=L, issue_type=S,
    resolution_type=S, admin_memo=S, resolved_at=S, linked_child_id=S,
)
ASK_LOGS = table(
    id=L, created_at=TimestampType(), session_id=S, question=S, answer=S, corpus_ids=STRINGS, sources=ArrayType(SOURCE), debug=S, answer_source=S,
    cache_hit=B, qa_cache_id=L, cache_similarity=D, cache_candidate_qa_id=L, cache_candidate_alias_id=L, cache_candidate_similarity=D,
    cache_miss_reason=S, cache_match_method=S, source_count=I, max_score=D, latency_ms=I, error_type=S,
)
PREDICTIONS = table(
    prediction_id=S, question_id=S, retrieval_mode=S, question=S, expected_answer=S, actual_answer=S, expected_source_hit=B, cache_hit=B, source_count=I,
    elapsed_sec=D, status=S, error=S,
)
FORMS = table(form_name=S, file_name=S, file_path=S, file_type=S, description=S)
MANUAL_SCORES = table(run_id=S, question_id=S, reviewer=S, total_score=D)
SEEDS = table(
    seed_id=S, approval_status=S, question=S, answer=S, evidence=ArrayType(EVIDENCE), corpus_ids=STRINGS, corpus_version=S, index_version=S, memo=S,
)
