"""Queries over model answers that break each rule, their export rows, and a whole enrichment run, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.constants import ANSWER_LISTS, ENRICHED_CSV
from stellwerk.operators import enrichment as E
from stellwerk.plans import views as V
from stellwerk.session import ship, table

FIELDS = {
    "category": '"Küche"', "seniority": '"entry"', "skills_required": '["a|b", " c "]', "skills_nice": "[]", "german_level": '"B1"', "german_evidence": '"Deutsch"', "english_sufficient": "false",
    "employment_type_norm": '"minijob"', "hours_per_week": "12", "duties_en": '["Wash dishes"]', "requirements_en": '["Be on time"]', "summary_en": '"Kitchen help."', "fit_score": "55", "fit_reasons": '["near"]',
    "missing_for_fit": "[]", "red_flags": "[]", "application_method": '"email"', "contact_email": "null", "contact_phone": '"0841 1"', "deadline": "null",
}
GERMAN = "Wir suchen dich für die Küche und das Lager, und wir sind ein Team"


def _with(**changed: str | None) -> str:
    """A valid answer with fields changed (JSON text) or left out (None)."""
    return "{" + ", ".join(f'"{n}": {v}' for n, v in (FIELDS | changed).items() if v is not None) + "}"


def _cases() -> list[tuple[str, str | None]]:
    """Answers and the rule that each breaks."""
    out: list[tuple[str, str | None]] = [(_with(), None), ("{broken", "not JSON"), ("[1]", "not an object"), ('"text"', "not an object"), (_with(more="[1, 2]"), None), (_with(hours_per_week="null"), None), (_with(hours_per_week="12.5", fit_score="0"), None)]
    for n in ("category", "seniority", "summary_en", "application_method"):
        out += [(_with(**{n: None}), f"{n} is missing"), (_with(**{n: "null"}), f"{n} is missing"), (_with(**{n: "5"}), f"{n} is not text"), (_with(**{n: '" "'}), f"{n} is empty")]
    for n in ("german_level", "employment_type_norm"):
        out += [(_with(**{n: None}), f"{n} is missing"), (_with(**{n: "5"}), f"{n} is not text"), (_with(**{n: '"B9"'}), f"{n} is not one of the allowed values")]
    out += [(_with(german_evidence=None), "german_evidence is missing"), (_with(german_evidence="[]"), "german_evidence is not text"), (_with(german_evidence='""'), "german_level without evidence"), (_with(german_evidence='""', german_level='"unclear"'), None)]
    out += [(_with(english_sufficient=None), "english_sufficient is missing"), (_with(english_sufficient='"no"'), "english_sufficient is not true or false"), (_with(english_sufficient="0"), "english_sufficient is not true or false")]
    for n in ANSWER_LISTS:
        out += [(_with(**{n: None}), f"{n} is missing"), (_with(**{n: '"x"'}), f"{n} is not a list"), (_with(**{n: "{}"}), f"{n} is not a list")]
    out += [(_with(fit_score=None), "fit_score is missing")] + [(_with(fit_score=x), "fit_score is not a number") for x in ('"55"', "true", "[]")] + [(_with(fit_score=x), "fit_score is out of range") for x in ("101", "-1", "100.5")]
    out += [(_with(hours_per_week='"12"'), "hours_per_week is not a number"), (_with(hours_per_week="81"), "hours_per_week is out of range"), (_with(hours_per_week="-2"), "hours_per_week is out of range")]
    out += [(_with(summary_en=f'"{GERMAN}"'), "summary_en is in German")]
    out += [(_with(**{n: f'["near", "{GERMAN}"]'}), f"{n} is in German") for n in ("duties_en", "requirements_en", "fit_reasons")]
    return out


CASES = _cases()


def q_answer_invalid_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule is broken by some job's answer: which one is told by the job's number."""
    case = (V.mark(F.col("job_id"), 3) % len(CASES) + 1).cast("int")
    answers = table(spark, sf_dir, "jobs").select("job_id", F.element_at(F.array(*[F.lit(a) for a, _ in CASES]), case).alias("answer"))
    return answers.select("job_id", E.answer_problem(F.col("answer")).alias("problem"))


def _full_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with all fields, made of the job's columns."""
    h = V.mark(F.col("job_id"), 0)
    answer = F.struct(
        F.coalesce("title", F.lit("-")).alias("category"), F.when(h % 2 == 0, "entry").otherwise("senior").alias("seniority"), F.array(F.coalesce("company", F.lit("a|b")), F.lit(" c "), F.lit("d|e|f")).alias("skills_required"),
        F.array().cast("array<string>").alias("skills_nice"), V.pick(V.LEVELS8, h).alias("german_level"), F.coalesce("city", F.lit("")).alias("german_evidence"), (h % 3 == 0).alias("english_sufficient"), F.lit("minijob").alias("employment_type_norm"),
        F.when(h % 5 != 0, h % 40).alias("hours_per_week"), F.array(F.lit("Wash"), F.lit("Cook")).alias("duties_en"), F.array(F.lit(" x|y ")).alias("requirements_en"), F.concat(F.lit("Job "), h.cast("string")).alias("summary_en"),
        (h % 101).alias("fit_score"), F.array(F.lit("near")).alias("fit_reasons"), F.array().cast("array<string>").alias("missing_for_fit"), F.array(F.lit("|")).alias("red_flags"), F.lit("email").alias("application_method"),
        F.when(h % 7 == 0, "a@b.example").alias("contact_email"), F.lit(None).cast("string").alias("contact_phone"), F.when(h % 11 == 0, "2026-09-01").alias("deadline"),
    )
    version = F.when(h % 4 == 0, "v2").otherwise("v1")
    return table(spark, sf_dir, "jobs").select("job_id", version.alias("prompt_version"), F.when(h % 37 == 0, "{broken").otherwise(F.to_json(answer)).alias("answer"), F.col("first_seen_at").alias("enriched_at"), "content_hash", F.lit("p1").alias("provider_used"))


def q_enriched_csv_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns; the moment is compared as one, not by its notation."""
    rows = E.enriched_rows(_full_answers(spark, sf_dir), V.VERSION)
    return rows.withColumn("enriched_at", F.col("enriched_at").cast("timestamp_ntz")).withColumn("hours_per_week", F.col("hours_per_week").cast("double")).withColumn("fit_score", F.col("fit_score").cast("double"))


_H = V.mark_sql("job_id", 0)
_CELL = lambda c: f"trim(replace({c}, '|', '/'), ' ')"
_ENRICHED = {
    "category": "coalesce(title, '-')", "seniority": "CASE WHEN h % 2 = 0 THEN 'entry' ELSE 'senior' END", "skills_required": f"{_CELL('coalesce(company, ' + repr('a|b') + ')')} || '|c|d/e/f'", "skills_nice": "''",
    "german_level": V.pick_sql(V.LEVELS8, "h"), "german_evidence": "coalesce(city, '')", "english_sufficient": "CASE WHEN h % 3 = 0 THEN 'true' ELSE 'false' END", "employment_type_norm": "'minijob'",
    "hours_per_week": "CASE WHEN h % 5 != 0 THEN (h % 40)::DOUBLE END", "duties_en": "'Wash|Cook'", "requirements_en": "'x/y'", "summary_en": "'Job ' || h::VARCHAR", "fit_score": "(h % 101)::DOUBLE", "fit_reasons": "'near'", "missing_for_fit": "''",
    "red_flags": "'/'", "application_method": "'email'", "contact_email": "CASE WHEN h % 7 = 0 THEN 'a@b.example' ELSE '' END", "contact_phone": "''", "deadline": "CASE WHEN h % 11 = 0 THEN '2026-09-01' ELSE '' END",
}

# A whole run ---------------------------------------------------------------------------------------------------------
TEMPLATE, DIGEST = "Read the ad.", "# Skills\n- Cooking"


def _model(prompts: list[str]) -> list[dict | Exception]:
    """A model without chance: the length of the prompt tells what it says."""
    out: list[dict | Exception] = []
    for p in prompts:
        n = len(p) % 5
        level = {"german_level": "B1", "german_evidence": "Deutsch"} if n in (1, 3) else {"german_level": "unclear", "german_evidence": ""}
        answer = {
            "category": "Job", "seniority": "entry", "skills_required": [], "skills_nice": [], "english_sufficient": True, "employment_type_norm": "unclear", "duties_en": [], "requirements_en": [], "summary_en": "A job.",
            "fit_score": len(p) % 101, "fit_reasons": [], "missing_for_fit": [], "red_flags": [], "application_method": "email",
        } | level
        out.append(RuntimeError("busy") if n == 0 else answer if n != 4 else {k: v for k, v in answer.items() if k != "category"})
    return out


def q_enrich_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    jobs, texts, stored = table(spark, sf_dir, "jobs"), table(spark, sf_dir, "job_descriptions"), V.answers(spark, sf_dir)
    work = E.needing_answer(jobs, texts, stored, V.VERSION)
    keyed = E.prompts(work, TEMPLATE, DIGEST).select("job_id", E.cache_key(V.VERSION, F.col("prompt"), "spec").alias("key"))
    told = F.lit('{"category": "Cached", "seniority": "entry", "skills_required": [], "skills_nice": [], "german_level": "A1", "german_evidence": "deutsch", "english_sufficient": true, "employment_type_norm": "unclear", "duties_en": [], "requirements_en": [], "summary_en": "A job.", "fit_score": 7, "fit_reasons": [], "missing_for_fit": [], "red_flags": [], "application_method": "email"}')
    cache = keyed.filter(V.mark(F.col("job_id"), 2) % 3 == 0).select("key", told.alias("answer")).distinct()
    skip = jobs.filter(V.mark(F.col("job_id"), 1) % 10 == 0).select("job_id")
    run = E.enrich(jobs, texts, stored, cache, _model, version=V.VERSION, template=TEMPLATE, digest=DIGEST, spec="spec", provider="p1", skip=skip)
    return run.select("job_id", "cached", "problem", "unevidenced", F.get_json_object("answer", "$.german_level").alias("german_level"), F.get_json_object("answer", "$.german_evidence").alias("german_evidence"), F.get_json_object("answer", "$.fit_score").cast("double").alias("fit_score"), "provider_used")


_FLAGS = "concat_ws(', ', CASE WHEN is_minijob THEN 'minijob' END, CASE WHEN is_werkstudent THEN 'werkstudent' END, CASE WHEN is_parttime THEN 'part-time' END, CASE WHEN is_fulltime THEN 'full-time' END, CASE WHEN is_internship THEN 'internship' END)"
_SAID = lambda name, c: f"'{name}: ' || coalesce(nullif({c}, ''), 'not stated')"
_FACTS = f"concat_ws(chr(10), {_SAID('Title', 'title')}, {_SAID('Company', 'company')}, {_SAID('City', 'city')}, 'Employment type as given: ' || nullif(employment_type_raw, ''), 'Flags: ' || nullif({_FLAGS}, ''), CASE WHEN homeoffice THEN 'Home office possible.' END, 'Apply at: ' || nullif(apply_url, ''))"
_GAP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_FLAT = r"replace(lower(description), 'ß', 'ss')"
_RUN = f"""WITH {V.ANSWERS_SQL}, v_work AS (SELECT j.*, d.description FROM jobs j JOIN job_descriptions d USING (job_id)
  LEFT JOIN (SELECT job_id, content_hash AS done_hash, true AS done FROM v_answer WHERE prompt_version = 'v1') e USING (job_id)
  WHERE length(trim(d.description, ' ')) > 0 AND (e.done IS NULL OR e.done_hash IS DISTINCT FROM sha1(d.description))),
v_prompt AS (SELECT job_id, description, '{TEMPLATE}' || {_GAP} || {_FACTS} || {_GAP} || trim(description, ' ') || {_GAP} || '{DIGEST.split(chr(10))[0]}' || chr(10) || '{DIGEST.split(chr(10))[1]}' AS prompt FROM v_work),
v_cache AS (SELECT DISTINCT prompt FROM v_prompt WHERE {V.mark_sql('job_id', 2)} % 3 = 0),
v_said AS (SELECT p.*, c.prompt IS NOT NULL AS cached, length(p.prompt) % 5 AS n FROM v_prompt p LEFT JOIN v_cache c USING (prompt) WHERE {V.mark_sql('job_id', 1)} % 10 != 0),
v_judged AS (SELECT *, CASE WHEN cached THEN NULL WHEN n = 0 THEN 'busy' WHEN n = 4 THEN 'category is missing' END AS problem, CASE WHEN cached THEN 'A1' WHEN n IN (1, 3) THEN 'B1' ELSE 'unclear' END AS lvl, contains({_FLAT}, 'deutsch') AS there FROM v_said)
SELECT job_id, cached, problem, problem IS NULL AND lvl != 'unclear' AND NOT there AS unevidenced, CASE WHEN problem IS NULL THEN CASE WHEN there THEN lvl ELSE 'unclear' END END AS german_level,
  CASE WHEN problem IS NULL THEN CASE WHEN there AND lvl != 'unclear' THEN CASE WHEN cached THEN 'deutsch' ELSE 'Deutsch' END ELSE '' END END AS german_evidence,
  CASE WHEN problem IS NULL THEN CASE WHEN cached THEN 7.0 ELSE (length(prompt) % 101)::DOUBLE END END AS fit_score, CASE WHEN problem IS NULL AND NOT cached THEN 'p1' END AS provider_used FROM v_judged"""

_quote = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
ORACLE = {
    "q_answer_invalid_reason": f"SELECT job_id, list_extract([{', '.join(_quote(p) for _, p in CASES)}], {V.mark_sql('job_id', 3)} % {len(CASES)} + 1) AS problem FROM jobs",
    "q_enriched_csv_row": f"SELECT job_id, first_seen_at AS enriched_at, 'v1' AS prompt_version, 'p1' AS provider_used, {', '.join(f'{_ENRICHED[n]} AS {n}' for n in ENRICHED_CSV[4:])} FROM (SELECT *, {_H} AS h FROM jobs) WHERE h % 4 != 0 AND h % 37 != 0",
    "q_enrich_run": _RUN,
}


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return ORACLE
