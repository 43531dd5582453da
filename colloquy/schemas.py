"""Schemas and enumerations of the data model."""

from __future__ import annotations

SOURCE_TYPES = ("transcript", "audio", "chat_export")
SOURCE_STATUS = ("ingested", "refused", "error")
EXTRACTION_TYPES = ("action", "decision", "risk", "signal")
REVIEW_STATUS = ("pending", "approved", "rejected", "expired")
TERMINAL_STATUS = ("approved", "rejected", "expired")
SEVERITIES = ("high", "medium", "low")
SIGNAL_CLASSES = ("decision", "blocker", "question", "request", "noise")
QUEUED_CLASSES = ("decision", "blocker", "request")
DATE_TYPES = ("absolute", "relative_resolved", "unspecified")
WRITE_OUTCOMES = ("created", "deduplicated", "blocked")
REVIEW_EVENTS = ("created", "edited", "approved", "rejected", "expired")
#: Blocking defects, the most telling first, and warnings.
BLOCKING_DEFECTS = ("undecodable_bytes", "empty_file", "unknown_format", "malformed_structure", "truncated_mid_sentence", "no_parseable_segments")
WARNING_DEFECTS = ("missing_speaker_label", "missing_timestamp", "non_monotonic_timestamp", "empty_segment_text", "replacement_characters")

DEFECT = "struct<code:string,severity:string,detail:string,line_number:int,excerpt:string>"
DEFECTS = f"array<{DEFECT}>"
RAW_SEGMENT = "struct<speaker:string,start_ts:string,end_ts:string,start_seconds:double,text:string,line_number:int>"
CITATION = "struct<source_id:string,source_title:string,segment_id:string,message_id:string,speaker:string,timestamp:string,quote:string,char_start:int,char_end:int>"

SOURCE = "source_id string, title string, source_type string, meeting_date date, participants array<string>, consent_flag boolean, status string, file_path string, content_hash string, reason string"
SEGMENT = "source_id string, segment_index int, segment_id string, speaker string, start_ts string, start_seconds double, end_ts string, text string, char_start int, char_end int"
CHAT_MESSAGE = "source_id string, id string, channel string, author string, ts string, text string, thread_id string"
EXTRACTION = (
    "id string, source_id string, extraction_type string, payload string, original_payload string, verbatim_quote string, quote_verified boolean, "
    "char_start int, char_end int, segment_id string, message_id string, speaker string, timestamp string, confidence double, status string, "
    "created_at timestamp, expires_at timestamp, reviewer string, reviewed_at timestamp, dedup_key string"
)
REVIEW_EVENT = "extraction_id string, event_type string, actor string, status_before string, status_after string, payload_before string, payload_after string, note string, created_at timestamp, seq long"
TRACKER_ITEM = "external_ref string, title string, description string, assignee string, status string, due_date string, labels array<string>, source_ref string, created_at timestamp, updated_at timestamp"
WRITE_ATTEMPT = "extraction_id string, outcome string, provider string, external_ref string, reason string, attempted_at timestamp"
LLM_CALL = "call_id string, attempt int, purpose string, prompt_version string, outcome string, cache_hit boolean, input_tokens long, output_tokens long, latency_ms double, created_at timestamp"
