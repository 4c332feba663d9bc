"""Declared schemas of inputs and results."""

from __future__ import annotations

SRT = "file_id string, ordinal int, index int, start_time double, end_time double, text string"
NULLABLE_SEGMENT = "file_id string, ordinal int, start double, end double, text string"
WORD = "struct<start:double,end:double,word:string>"
ASR_ITEMS = f"array<struct<start:double,end:double,text:string,words:array<{WORD}>>>"
VAD_DOC = "sample_rate int, num_segments int, segments array<struct<start:double,end:double,duration:double>>"
METRIC_LOG = (
    "msg string, time string, metric_type string, cpk string, request_count int, ongoing_count int, queued_at_start int, batch_id string, "
    "balanced_cpks array<string>, dedicated_cpks array<string>, shared_cpks array<string>"
)
ARTICLE = "title string, press string, date string, summary string"
STATUS_EVENT = "seq long, req_uid string, content_id string, filename string, inc int"
TRANSCRIPT = "text string, segments array<struct<idx:int,startTime:double,endTime:double,sentence:string>>"
EDITS = "struct<dist:int,s:int,d:int,i:int>"
