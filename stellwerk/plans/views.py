"""Inputs that the test tables lack, derived from them by the same rule in Spark and in SQL.

Answers of a model, recorded pages of other sources, map elements and sightings are functions of digests of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.constants import KIND_SCORES, LEVELS
from stellwerk.functions.dates import published_on
from stellwerk.operators import listing as L
from stellwerk.session import new_folder, table

NOW = "2026-08-10 00:00:00"
VERSION = "v1"
LEVELS8 = [*LEVELS, "unclear"]
KINDS = [*KIND_SCORES, "ice_rink"]
CUISINES = ["", "persian;grill", "bavarian", "italian", "Irish ; pizza"]


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def mark(text: Column, k: int) -> Column:
    """The k-th group of four hexadecimal digits of a digest, as a number."""
    return F.conv(F.substring(F.md5(text), 4 * k + 1, 4), 16, 10).cast("int")


def mark_sql(text: str, k: int) -> str:
    return f"('0x' || substr(md5({text}), {4 * k + 1}, 4))::INT"


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def pick_sql(values: list[str], n: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], (({n}) % {len(values)}) + 1)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").withColumn("published_on", published_on(F.col("published_at")))


#: Folders of stored lists by application and tables.
_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Jobs and answers as the list reads them, stored once in a session (see :func:`listing.store`)."""
    corpus = (spark.sparkContext.applicationId, sf_dir)
    if corpus not in _STORED:
        _STORED[corpus] = L.store(table(spark, sf_dir, "jobs"), answers(spark, sf_dir), VERSION, new_folder(spark, "list"))
    return L.stored(spark, _STORED[corpus])


def _iso(k: int, col: str) -> str:
    pattern = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
    return f"regexp_extract(trim({col}), '{pattern}', {k})"


def published_on_sql(col: str = "published_at") -> str:
    n = lambda x: f"coalesce(try_cast(nullif({x}, '') AS INT), 0)"
    digits = f"regexp_replace({_iso(7, col)}, '[^0-9]', '', 'g')"
    minutes = f"({n(f'substr({digits}, 1, 2)')} * 60 + {n(f'substr({digits}, 3, 2)')})"
    shift = f"CASE WHEN {_iso(7, col)} LIKE '-%' THEN -{minutes} WHEN {_iso(7, col)} LIKE '+%' THEN {minutes} ELSE 0 END"
    day = f"try_cast({_iso(1, col)} || '-' || {_iso(2, col)} || '-' || {_iso(3, col)} AS DATE)"
    exact = f"CASE WHEN {_iso(1, col)} != '' AND {n(_iso(4, col))} < 24 AND {n(_iso(5, col))} < 60 AND {n(_iso(6, col))} < 60 THEN {day} + CAST(floor(({n(_iso(4, col))} * 60 + {n(_iso(5, col))} - {shift}) / 1440.0) AS INT) END"
    plain = f"CASE WHEN regexp_matches(trim({col}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substr(trim({col}), 1, 10) AS DATE) END"
    return f"(SELECT CASE WHEN year(d) BETWEEN 1990 AND 2100 THEN d END FROM (SELECT coalesce({exact}, {plain}) AS d))"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers: three jobs in four have one, at one of two versions; some are no JSON."""
    j = table(spark, sf_dir, "jobs").select("job_id", "content_hash", "first_seen_at", mark(F.col("job_id"), 0).alias("h"), mark(F.col("job_id"), 1).alias("g"))
    level = pick(LEVELS8, F.col("h"))
    text = F.concat(
        F.lit('{"german_level": "'), level, F.lit('", "german_evidence": "'), F.when(F.col("h") % 5 == 0, "").otherwise("Deutsch"), F.lit('", "fit_score": '), (F.col("g") % 101).cast("string"),
        F.lit(', "summary_en": "Job '), (F.col("g") % 17).cast("string"), F.lit('", "english_sufficient": '), F.when(F.col("g") % 2 == 0, "true").otherwise("false"), F.lit(', "skills_required": ["a|b", " c "]}'),
    )
    return j.filter("h % 4 != 0").select(
        "job_id", F.when(F.col("h") % 3 == 0, "v2").otherwise("v1").alias("prompt_version"), F.when(F.col("h") % 37 == 0, F.lit("{broken")).otherwise(text).alias("answer"),
        (F.col("first_seen_at") + F.make_dt_interval(F.lit(1))).alias("enriched_at"), F.when(F.col("g") % 2 == 0, F.col("content_hash")).otherwise("other").alias("content_hash"), F.lit("p1").alias("provider_used"),
    )


ANSWERS_SQL = f"""
v_mark AS (SELECT *, {mark_sql("job_id", 0)} AS h, {mark_sql("job_id", 1)} AS g FROM jobs),
v_answer AS (SELECT job_id, CASE WHEN h % 3 = 0 THEN 'v2' ELSE 'v1' END AS prompt_version,
  CASE WHEN h % 37 = 0 THEN '{{broken' ELSE '{{"german_level": "' || {pick_sql(LEVELS8, "h")} || '", "german_evidence": "' || CASE WHEN h % 5 = 0 THEN '' ELSE 'Deutsch' END
    || '", "fit_score": ' || (g % 101)::VARCHAR || ', "summary_en": "Job ' || (g % 17)::VARCHAR || '", "english_sufficient": ' || CASE WHEN g % 2 = 0 THEN 'true' ELSE 'false' END || ', "skills_required": ["a|b", " c "]}}' END AS answer,
  first_seen_at + INTERVAL 1 DAY AS enriched_at, CASE WHEN g % 2 = 0 THEN content_hash ELSE 'other' END AS content_hash, 'p1' AS provider_used
  FROM v_mark WHERE h % 4 != 0)"""
JOBS_SQL = f"v_jobs AS (SELECT *, {published_on_sql()} AS published_on FROM jobs)"


def json_field(name: str, col: str = "answer") -> str:
    return f"CASE WHEN json_valid({col}) THEN json_extract_string({col}, '$.{name}') END"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_postings").withColumn("seq", F.col("posting_no"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements: one per customer, sightings in several runs."""
    c = table(spark, sf_dir, "customer").withColumn("h", mark(F.col("c_name"), 0)).withColumn("g", mark(F.col("c_name"), 1))
    kind = pick(KINDS, F.col("h"))
    tags = F.map_from_arrays(
        F.array(*map(F.lit, ["name", "amenity", "phone", "contact:email", "website", "addr:street", "addr:housenumber", "cuisine"])),
        F.array(
            F.when(F.col("h") % 11 != 0, F.col("c_name")), F.when(F.col("g") % 13 != 0, kind), F.when(F.col("g") % 3 == 0, F.concat(F.lit("08431/"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(" (Küche)"))),
            F.when(F.col("g") % 4 == 0, F.concat(F.lit("info@place"), F.col("c_custkey").cast("string"), F.lit(".example"))), F.when(F.col("g") % 5 == 0, F.lit("https://place.example")),
            F.when(F.col("h") % 2 == 0, F.lit("Hauptstraße")), F.when(F.col("h") % 4 == 0, (F.col("h") % 90).cast("string")), pick(CUISINES, F.col("g")),
        ),
    )
    return c.select(F.lit("node").alias("type"), F.col("c_custkey").alias("id"), (F.lit(48.0) + F.col("h") / 100000.0).alias("lat"), F.lit(None).cast("double").alias("lon"), F.struct(F.lit(1.0).alias("lat"), (F.lit(11.0) + F.col("g") / 100000.0).alias("lon")).alias("center"), tags.alias("tags"))


PLACES_SQL = f"""
v_place AS (SELECT 'node/' || c_custkey::VARCHAR AS contact_id, c_name AS name, {pick_sql(KINDS, "h")} AS kind, 'Ingolstadt' AS city,
  CASE WHEN h % 4 = 0 THEN 'Hauptstraße ' || (h % 90)::VARCHAR WHEN h % 2 = 0 THEN 'Hauptstraße' END AS street,
  CASE WHEN g % 3 = 0 THEN '+498431' || lpad(c_custkey::VARCHAR, 6, '0') END AS phone,
  CASE WHEN g % 4 = 0 THEN 'info@place' || c_custkey::VARCHAR || '.example' END AS email, CASE WHEN g % 5 = 0 THEN 'https://place.example' END AS website,
  48.0 + h / 100000.0 AS lat, 11.0 + g / 100000.0 AS lon, {pick_sql(CUISINES, "g")} AS cuisine, h, g, c_custkey
  FROM (SELECT *, {mark_sql("c_name", 0)} AS h, {mark_sql("c_name", 1)} AS g FROM customer)
  WHERE h % 11 != 0 AND g % 13 != 0 AND (g % 3 = 0 OR g % 4 = 0 OR g % 5 = 0))"""
