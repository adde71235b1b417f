"""Queries over the list of jobs and over model answers, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.constants import GERMAN_WORDS, HOME, JOBS_CSV
from stellwerk.functions.geo import km_from_home
from stellwerk.functions.text import reads_as_german
from stellwerk.operators import enrichment as E
from stellwerk.operators import listing as L
from stellwerk.plans import views as V
from stellwerk.session import table

FILTERS = {
    "q_list_fit": L.JobFilters(sort="fit"),
    "q_list_fit_page2": L.JobFilters(sort="fit", page=2),
    "q_list_date": L.JobFilters(sort="date"),
    "q_list_distance": L.JobFilters(sort="distance"),
}
BOUNDS = {
    "q_filter_status": L.JobFilters(statuses=("applied", "new")),
    "q_filter_city_source": L.JobFilters(cities=("Zwiesau", "Buchenberg"), sources=("BA", "AZ")),
    "q_filter_types_or": L.JobFilters(types=("minijob", "internship")),
    "q_filter_max_german": L.JobFilters(max_german="B1"),
    "q_filter_min_fit": L.JobFilters(min_fit=60),
    "q_filter_posted_within": L.JobFilters(posted_within=30),
}


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    jobs, answers = V.stored(spark, sf_dir)
    return jobs, table(spark, sf_dir, "job_status"), answers


def _list(filters: L.JobFilters):
    return lambda spark, sf_dir: L.listing(*_inputs(spark, sf_dir), filters, V.now())


def _bound(filters: L.JobFilters):
    return lambda spark, sf_dir: L.matching(*_inputs(spark, sf_dir), filters, V.now()).select("job_id", "city", "source", "status", "german_level", "fit_score", "published_on")


RANK = "CASE german_level WHEN 'none' THEN 0 WHEN 'A1' THEN 1 WHEN 'A2' THEN 2 WHEN 'B1' THEN 3 WHEN 'B2' THEN 4 WHEN 'C1' THEN 5 WHEN 'C2' THEN 6 ELSE -1 END"
TIER = f"CASE WHEN {RANK} < 0 THEN 'unknown' WHEN {RANK} <= 2 THEN 'comfortable' WHEN {RANK} = 3 THEN 'stretch' ELSE 'out' END"
LABEL = "coalesce(nullif(concat_ws(' / ', CASE WHEN is_minijob THEN 'minijob' END, CASE WHEN is_werkstudent THEN 'werkstudent' END, CASE WHEN is_parttime THEN 'part-time' END, CASE WHEN is_fulltime THEN 'full-time' END, CASE WHEN is_internship THEN 'internship' END), ''), employment_type_raw, '')"
KM = f"CAST(round_even(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - {HOME[0]}) / 2), 2) + cos(radians({HOME[0]})) * cos(radians(lat)) * pow(sin(radians(lon - {HOME[1]}) / 2), 2))), 0) AS INT)"
STALE = f"coalesce(last_seen_at < TIMESTAMP '{V.NOW}' - INTERVAL 14 DAY, true)"
BASE = f"""WITH {V.ANSWERS_SQL}, {V.JOBS_SQL},
v_list AS (SELECT j.*, coalesce(s.status, 'new') AS status, a.german_level, a.fit_score, a.summary_en FROM v_jobs j
  LEFT JOIN (SELECT job_id, {V.json_field("german_level")} AS german_level, try_cast({V.json_field("fit_score")} AS DOUBLE) AS fit_score, {V.json_field("summary_en")} AS summary_en FROM v_answer WHERE prompt_version = 'v1') a USING (job_id)
  LEFT JOIN job_status s USING (job_id))"""
ORDERS = {
    "fit": "fit_score DESC NULLS LAST, last_seen_at DESC NULLS LAST, job_id",
    "date": "published_at DESC NULLS LAST, first_seen_at DESC NULLS LAST, job_id",
    "distance": "distance_km ASC NULLS LAST, job_id",
}
WHERE = {
    "q_filter_status": "status IN ('applied', 'new')",
    "q_filter_city_source": "status != 'deleted' AND city IN ('Zwiesau', 'Buchenberg') AND source IN ('BA', 'AZ')",
    "q_filter_types_or": "status != 'deleted' AND (is_minijob OR is_internship)",
    "q_filter_max_german": f"status != 'deleted' AND {RANK} BETWEEN 0 AND 3",
    "q_filter_min_fit": "status != 'deleted' AND fit_score >= 60",
    "q_filter_posted_within": f"status != 'deleted' AND published_on >= DATE '{V.NOW[:10]}' - 30",
}


def _list_sql(name: str, f: L.JobFilters) -> str:
    return f"{BASE} SELECT {', '.join(L.LIST_COLUMNS)}, status, german_level, fit_score, summary_en, distance_km, {TIER} AS tier, {STALE} AS stale, {LABEL} AS type_label FROM (SELECT *, {KM} AS distance_km FROM v_list WHERE status != 'deleted') ORDER BY {ORDERS[f.sort]} LIMIT 50 OFFSET {(f.page - 1) * 50}"


def q_total_count(spark, sf_dir):
    return L.total(*_inputs(spark, sf_dir), L.JobFilters(types=("minijob",)), V.now())


def q_facets_city(spark, sf_dir):
    return L.facet(table(spark, sf_dir, "jobs"), "city")


def q_facets_source(spark, sf_dir):
    return L.facet(table(spark, sf_dir, "jobs"), "source")


def q_job_detail(spark, sf_dir):
    jobs = V.jobs(spark, sf_dir)
    first = jobs.filter("has_description").agg(F.min("job_id")).collect()[0][0]
    return L.job_page(jobs, table(spark, sf_dir, "job_status"), table(spark, sf_dir, "job_descriptions"), V.answers(spark, sf_dir), first, V.VERSION, V.now())


def q_default_status_export(spark, sf_dir):
    s = table(spark, sf_dir, "job_status").select("job_id", "status")
    return table(spark, sf_dir, "jobs").join(s, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("new"))).select(*JOBS_CSV)


def q_type_label(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", L.type_label().alias("type_label"))


def q_german_tier(spark, sf_dir):
    return L.answers_at(V.answers(spark, sf_dir), V.VERSION).select("job_id", L.german_tier(F.col("german_level")).alias("tier"))


def q_distance_km(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", km_from_home(F.col("lat"), F.col("lon")).alias("distance_km"))


def q_stale_flag(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", L.stale(V.now()).alias("stale"))


def _pending(spark, sf_dir):
    return E.needing_answer(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "job_descriptions"), V.answers(spark, sf_dir), V.VERSION)


def q_needs_enrichment(spark, sf_dir):
    return _pending(spark, sf_dir).select("job_id", "text_hash")


def q_enrichment_queue(spark, sf_dir):
    return E.queue(_pending(spark, sf_dir), 100).select("job_id", "first_seen_at")


def q_pending_count(spark, sf_dir):
    return E.pending_count(_pending(spark, sf_dir))


def q_already_count(spark, sf_dir):
    return E.answered_count(V.answers(spark, sf_dir), V.VERSION)


def q_reads_as_german(spark, sf_dir):
    return table(spark, sf_dir, "job_descriptions").select("job_id", reads_as_german(F.col("description")).alias("german"))


def _quoted(spark, sf_dir):
    a = V.answers(spark, sf_dir).filter(F.col("prompt_version") == V.VERSION)
    field = lambda n: F.get_json_object("answer", f"$.{n}")
    return a.join(table(spark, sf_dir, "job_descriptions").select("job_id", "description"), "job_id").select("job_id", field("german_level").alias("lvl"), field("german_evidence").alias("evidence"), "description")


def q_evidence(spark, sf_dir):
    return _quoted(spark, sf_dir).select("job_id", E.evidence_holds(F.col("lvl"), F.col("evidence"), F.col("description")).alias("holds"))


def q_grounding(spark, sf_dir):
    level, evidence = E.grounded(F.col("lvl"), F.col("evidence"), F.col("description"))
    return _quoted(spark, sf_dir).select("job_id", level.alias("german_level"), evidence.alias("german_evidence"))


def q_enrichment_latest(spark, sf_dir):
    a = V.answers(spark, sf_dir)
    again = a.filter(V.mark(F.col("job_id"), 2) % 2 == 0).withColumn("enriched_at", F.col("enriched_at") + F.make_dt_interval(F.lit(3))).withColumn("provider_used", F.lit("p2"))
    return E.latest_answers(a.unionByName(again)).select("job_id", "prompt_version", "enriched_at", "provider_used")


def q_answer_cache_hits(spark, sf_dir):
    asked = table(spark, sf_dir, "job_descriptions").filter("description IS NOT NULL").select("job_id", E.cache_key("v1", F.col("description"), "spec").alias("key"))
    cache = asked.filter(V.mark(F.col("job_id"), 2) % 3 == 0).groupBy("key").agg(F.min("job_id").alias("answer"))
    return E.with_cached(asked, cache).select("job_id", F.col("cached_answer").isNotNull().alias("hit"))


_FLAT = lambda c: f"replace(lower(trim(regexp_replace(coalesce({c}, ''), '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'))), 'ß', 'ss')"
_PENDING_SQL = f"""WITH {V.ANSWERS_SQL}, v_pending AS (SELECT j.job_id, j.first_seen_at, sha1(d.description) AS text_hash FROM jobs j JOIN job_descriptions d USING (job_id)
  LEFT JOIN (SELECT job_id, content_hash AS done_hash, true AS done FROM v_answer WHERE prompt_version = 'v1') e USING (job_id)
  WHERE length(trim(d.description, ' ')) > 0 AND (e.done IS NULL OR e.done_hash IS DISTINCT FROM sha1(d.description)))"""
_QUOTED_SQL = f"""WITH {V.ANSWERS_SQL}, v_q AS (SELECT a.job_id, {V.json_field("german_level")} AS lvl, {V.json_field("german_evidence")} AS evidence, d.description FROM v_answer a JOIN job_descriptions d USING (job_id) WHERE prompt_version = 'v1'),
  v_h AS (SELECT *, coalesce(lvl = 'unclear' OR (length({_FLAT("evidence")}) > 0 AND contains({_FLAT("description")}, {_FLAT("evidence")})), false) AS holds FROM v_q)"""
_WORDS = ", ".join(f"'{w}'" for w in GERMAN_WORDS)

ORACLE = {n: _list_sql(n, f) for n, f in FILTERS.items()} | {n: f"{BASE} SELECT job_id, city, source, status, german_level, fit_score, published_on FROM v_list WHERE {w}" for n, w in WHERE.items()}
ORACLE |= {
    "q_total_count": f"{BASE} SELECT count(*) AS total FROM v_list WHERE status != 'deleted' AND is_minijob",
    "q_facets_city": "SELECT DISTINCT city FROM jobs WHERE city IS NOT NULL ORDER BY city",
    "q_facets_source": "SELECT DISTINCT source FROM jobs WHERE source IS NOT NULL ORDER BY source",
    "q_job_detail": f"{BASE} SELECT {', '.join('l.' + c for c in L.LIST_COLUMNS)}, l.status, s.notes, d.description, CASE WHEN json_valid(a.answer) THEN a.answer END AS answer, {STALE} AS stale, {LABEL} AS type_label FROM v_list l LEFT JOIN job_status s USING (job_id) LEFT JOIN job_descriptions d USING (job_id) LEFT JOIN (SELECT job_id, answer FROM v_answer WHERE prompt_version = 'v1') a USING (job_id) WHERE l.job_id = (SELECT min(job_id) FROM jobs WHERE has_description)",
    "q_default_status_export": f"SELECT {', '.join('j.' + c for c in JOBS_CSV[:-1])}, coalesce(s.status, 'new') AS status FROM jobs j LEFT JOIN job_status s USING (job_id)",
    "q_type_label": f"SELECT job_id, {LABEL} AS type_label FROM jobs",
    "q_german_tier": f"WITH {V.ANSWERS_SQL} SELECT job_id, {TIER} AS tier FROM (SELECT job_id, {V.json_field('german_level')} AS german_level FROM v_answer WHERE prompt_version = 'v1')",
    "q_distance_km": f"SELECT job_id, {KM} AS distance_km FROM jobs",
    "q_stale_flag": f"SELECT job_id, {STALE} AS stale FROM jobs",
    "q_needs_enrichment": f"{_PENDING_SQL} SELECT job_id, text_hash FROM v_pending",
    "q_enrichment_queue": f"{_PENDING_SQL} SELECT job_id, first_seen_at FROM v_pending ORDER BY first_seen_at, job_id LIMIT 100",
    "q_pending_count": f"{_PENDING_SQL} SELECT count(*) AS pending FROM v_pending",
    "q_already_count": f"WITH {V.ANSWERS_SQL} SELECT count(*) AS answered FROM v_answer WHERE prompt_version = 'v1'",
    "q_reads_as_german": f"SELECT job_id, coalesce((SELECT count(DISTINCT w) FROM (SELECT replace(lower(trim(unnest(string_split(trim(regexp_replace(description, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g')), ' ')), '.,;:!?()[]\"''')), 'ß', 'ss') AS w) WHERE w IN ({_WORDS})), 0) >= 3 AS german FROM job_descriptions",
    "q_evidence": f"{_QUOTED_SQL} SELECT job_id, holds FROM v_h",
    "q_grounding": f"{_QUOTED_SQL} SELECT job_id, CASE WHEN holds THEN lvl ELSE 'unclear' END AS german_level, CASE WHEN holds THEN evidence ELSE '' END AS german_evidence FROM v_h",
    "q_enrichment_latest": f"WITH {V.ANSWERS_SQL} SELECT job_id, prompt_version, CASE WHEN {V.mark_sql('job_id', 2)} % 2 = 0 THEN enriched_at + INTERVAL 3 DAY ELSE enriched_at END AS enriched_at, CASE WHEN {V.mark_sql('job_id', 2)} % 2 = 0 THEN 'p2' ELSE 'p1' END AS provider_used FROM v_answer",
    "q_answer_cache_hits": f"WITH k AS (SELECT job_id, sha1('v1' || chr(31) || sha1(description) || chr(31) || 'spec') AS key FROM job_descriptions WHERE description IS NOT NULL), c AS (SELECT DISTINCT key FROM k WHERE {V.mark_sql('job_id', 2)} % 3 = 0) SELECT k.job_id, c.key IS NOT NULL AS hit FROM k LEFT JOIN c USING (key)",
}


def queries() -> dict:
    made = {n: _list(f) for n, f in FILTERS.items()} | {n: _bound(f) for n, f in BOUNDS.items()}
    return made | {n: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return ORACLE
