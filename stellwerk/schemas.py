"""Schemas of the tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

from stellwerk.constants import ANSWER_LISTS

S, B, D, I, L, TS = T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FLAGS = dict.fromkeys(("is_minijob", "is_parttime", "is_fulltime", "is_internship", "is_werkstudent", "homeoffice"), B)
RAW_POSTING = struct(job_id=S, source=S, source_id=S, title=S, company=S, city=S, plz=S, lat=D, lon=D, employment_type_raw=S, **FLAGS, published_at=S, apply_url=S, source_url=S, description=S)
JOBS = struct(
    job_id=S, source=S, source_id=S, dedupe_key=S, title=S, company=S, city=S, plz=S, lat=D, lon=D, employment_type_raw=S, **FLAGS,
    published_at=S, published_on=T.DateType(), apply_url=S, source_url=S, also_seen_on=S, has_description=B, content_hash=S, first_seen_at=TS, last_seen_at=TS,
)
JOB_DESCRIPTIONS = struct(job_id=S, description=S, updated_at=TS)
STATUS = struct(job_id=S, status=S, notes=S, updated_at=TS, applied_on=TS)
ENRICHMENT = struct(job_id=S, prompt_version=S, answer=S, enriched_at=TS, content_hash=S, provider_used=S)
ANSWER = struct(
    category=S, seniority=S, german_level=S, german_evidence=S, english_sufficient=B, employment_type_norm=S, hours_per_week=D, summary_en=S, fit_score=D,
    application_method=S, contact_email=S, contact_phone=S, deadline=S, **{n: T.ArrayType(S) for n in ANSWER_LISTS},
)
PLACE = struct(contact_id=S, name=S, kind=S, city=S, street=S, phone=S, email=S, website=S, lat=D, lon=D, tags=T.MapType(S, S))
CONTACTS = struct(
    contact_id=L, osm_id=S, name=S, kind=S, city=S, street=S, phone=S, email=S, website=S, back_of_house_score=D, score_reason=S, lat=D, lon=D,
    script=S, email_draft=S, first_seen_at=TS, last_contacted_at=TS, outcome=S, notes=S,
)
RUNS = struct(id=L, kind=S, spec=S, sources=S, state=S, started_at=TS, last_progress_at=TS, finished_at=TS, found_count=I, new_count=I, duplicate_count=I, errors=S, enriched_count=I, contacts_count=I)
RUN_SOURCES = struct(run_id=L, source=S, found_count=I, new_count=I, duplicate_count=I, state=S, last_event_at=TS)
SOURCE_STATE = struct(source=S, query_hash=S, last_query_index=I, last_completed_page=I, last_success_at=TS, consecutive_failures=I, cooldown_until=TS, last_error=S)
RESPONSE_CACHE = struct(cache_key=S, url=S, status=I, body=T.BinaryType(), fetched_at=TS)
RESUME = struct(
    name=S,
    languages=T.ArrayType(struct(name=S, level=S, normalized=S)),
    experience=T.ArrayType(struct(title=S, company=S, start=S, end=S)),
    education=T.ArrayType(struct(degree=S, school=S)),
    skill_groups=T.MapType(S, T.ArrayType(S)),
)
