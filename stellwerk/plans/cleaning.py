"""Queries of the general cleaning operators: timestamps and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellwerk.operators import shred, timestamps
from stellwerk.session import ship, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    jobs = table(spark, sf_dir, "jobs").select("job_id", "published_at", "first_seen_at")
    return timestamps.with_epoch_seconds(jobs, "published_at", "first_seen_at").filter("epoch_s IS NOT NULL").select("job_id", "epoch_s")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return shred.places_of_entries(table(spark, sf_dir, "jobs_werkstudent_ingolstadt"))


_LIST = lambda v: f"CASE json_type({v}) WHEN 'ARRAY' THEN json_extract({v}, '$[*]') WHEN 'OBJECT' THEN [{v}] ELSE [] END"
_P6 = f"""WITH p AS (SELECT page_id, {_LIST("json_extract(payload, '$.ergebnisliste')")} AS es FROM jobs_werkstudent_ingolstadt WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
e AS (SELECT page_id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS entry_no FROM p),
l AS (SELECT page_id, entry_no, {_LIST("json_extract(e, '$.stellenlokationen')")} AS ls FROM e WHERE json_type(e) = 'OBJECT' AND length(json_extract_string(e, '$.referenznummer')) > 0),
a AS (SELECT page_id, entry_no, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS loc_no FROM l),
f AS (SELECT page_id, entry_no, loc_no, coalesce(json_extract_string(l, '$.adresse.ort'), '') AS ort, regexp_extract(trim(coalesce(json_extract_string(l, '$.adresse.plz'), '')), '^(?:[Dd][Ee]?[- ]?)?(\\d{{1,5}})(?:\\.0)?$', 1) AS d FROM a)
SELECT DISTINCT page_id, entry_no::INT AS entry_no, loc_no::INT AS loc_no, ort, CASE WHEN d = '' THEN '' ELSE lpad(d, 5, '0') END AS plz FROM f WHERE ort != '' OR d != ''"""


def queries() -> dict:
    return {"p2_found": p2_found, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": _P6}
