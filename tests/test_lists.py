from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stellwerk.operators import enrichment as E
from stellwerk.operators import listing as L
from stellwerk.schemas import ENRICHMENT, JOB_DESCRIPTIONS, JOBS, STATUS

NOW = datetime(2026, 8, 20)


def job(job_id, city, flag=None, published=None, lat=48.7665, lon=11.4258, last=NOW):
    base = dict.fromkeys(f.name for f in JOBS)
    base |= {f: False for f in ("is_minijob", "is_parttime", "is_fulltime", "is_internship", "is_werkstudent", "homeoffice")}
    base |= {"job_id": job_id, "source": job_id[:2], "title": "t", "city": city, "lat": lat, "lon": lon, "published_on": published and datetime.fromisoformat(published).date(), "published_at": published, "first_seen_at": NOW, "last_seen_at": last}
    return tuple((base | ({flag: True} if flag else {}))[f.name] for f in JOBS)


@pytest.fixture(scope="module")
def store(spark):
    jobs = spark.createDataFrame([job("BA:1", "Ingolstadt", "is_minijob", "2026-08-19"), job("BA:2", "München", "is_werkstudent", "2026-08-01", None), job("BA:3", "Ingolstadt", "is_minijob"), job("AN:4", "München", "is_parttime", "2026-08-15", last=None), job("BA:5", "Ingolstadt")], JOBS)
    status = spark.createDataFrame([("BA:5", "deleted", None, NOW, None), ("BA:2", "new", None, NOW, None)], STATUS)
    answer = '{"german_level": "%s", "fit_score": %s, "summary_en": "s"}'
    rows = [("BA:1", "v1", answer % ("B1", 60)), ("BA:2", "v1", answer % ("C1", 85)), ("BA:3", "v1", answer % ("unclear", 40)), ("AN:4", "v1", answer % ("A2", 95)), ("BA:3", "v2", answer % ("A1", 99)), ("BA:5", "v1", "{broken")]
    enrichment = spark.createDataFrame([(j, v, a, NOW, "h", "p") for j, v, a in rows], ENRICHMENT)
    return jobs, status, enrichment


def ids(store, **query):
    jobs, status, enrichment = store
    rows = L.listing(jobs, status, L.answers_at(enrichment, "v1"), L.parse_filters(query), F.lit(NOW))
    return [r.job_id for r in rows.collect()]


def test_lists(store):
    assert ids(store) == ["AN:4", "BA:2", "BA:1", "BA:3"]
    assert set(ids(store, max_german="B1")) == {"BA:1", "AN:4"}
    assert ids(store, city="Ingolstadt", type="minijob", min_fit="50") == ["BA:1"]
    assert ids(store, posted_within="7") == ["AN:4", "BA:1"]
    assert ids(store, status=["deleted"]) == ["BA:5"]
    assert ids(store, sort="distance")[-1] == "BA:2"
    assert ids(store, sort="date") == ["BA:1", "AN:4", "BA:2", "BA:3"]
    assert ids(store, page="2") == [] and ids(store, type=["minijob", "parttime"]) == ["AN:4", "BA:1", "BA:3"]


def test_parse_filters():
    f = L.parse_filters({"type": ["minijob", "x", "minijob"], "min_fit": "101", "max_german": "Z9", "posted_within": "5", "page": "-3", "sort": "?", "status": "applied"})
    assert f == L.JobFilters(types=("minijob",), statuses=("applied",)) and L.describe(f) == "minijob; applied"
    assert L.describe(L.JobFilters(cities=("A", "B", "C"))) == "A, B or C" and L.pages(0) == 1 and L.pages(101) == 3


def test_page_and_columns(store):
    jobs, status, enrichment = store
    rows = {r.job_id: r for r in L.listing(jobs, status, L.answers_at(enrichment, "v1"), L.JobFilters(statuses=("new", "deleted")), F.lit(NOW)).collect()}
    assert (rows["BA:1"].tier, rows["BA:2"].tier, rows["BA:3"].tier, rows["AN:4"].tier) == ("stretch", "out", "unknown", "comfortable")
    assert rows["AN:4"].stale and not rows["BA:1"].stale and rows["BA:1"].distance_km == 18 and rows["BA:2"].distance_km is None
    d = store[0].sparkSession.createDataFrame([("BA:1", "text", NOW)], JOB_DESCRIPTIONS)
    one = L.job_page(jobs, status, d, enrichment, "BA:1", "v1", F.lit(NOW)).collect()
    assert len(one) == 1 and one[0].description == "text" and L.job_page(jobs, status, d, enrichment, "BA:5", "v1", F.lit(NOW)).collect()[0].answer is None
    assert L.total(jobs, status, L.answers_at(enrichment, "v1"), L.JobFilters(), F.lit(NOW)).collect()[0][0] == 4


def test_list_plan_reads_little(store, spark, data):
    jobs = spark.read.parquet(f"{data}/jobs.parquet").filter(F.col("source").isin("BA"))
    plan = jobs.select("job_id", "city")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,BA)]" in plan or "In(source" in plan
    assert "ReadSchema: struct<job_id:string,source:string,city:string>" in plan or "company" not in plan.split("ReadSchema")[1]


def test_filters_reach_the_scans(spark, data, tmp_path):
    """The library's own plan over its stored list: bounds are compared at the scans, no request parses dates or JSON."""
    from stellwerk.plans import views as V

    folder = L.store(spark.read.parquet(f"{data}/jobs.parquet"), V.answers(spark, data), V.VERSION, str(tmp_path))
    filters = L.JobFilters(sources=("BA",), posted_within=30, max_german="B1", min_fit=60)
    jobs, answers = L.stored(spark, folder)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    found = L.matching(jobs, spark.read.parquet(f"{data}/job_status.parquet"), answers, filters, V.now())
    plan = found._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    pushed = " ".join(x for x in plan.split("PushedFilters: ")[1:])
    assert "GreaterThanOrEqual(published_on,2026-07-11)" in pushed and "EqualTo(source,BA)" in pushed
    assert "GreaterThanOrEqual(german_rank,0)" in pushed and "LessThanOrEqual(german_rank,3)" in pushed and "GreaterThanOrEqual(fit_score,60.0)" in pushed
    assert "regexp" not in plan.lower() and "get_json_object" not in plan.lower()


def test_queue(spark, store):
    from stellwerk.functions.text import content_hash

    jobs, _, enrichment = store
    texts = spark.createDataFrame([("BA:1", "x", NOW), ("BA:2", " ", NOW), ("BA:3", "y", NOW), ("AN:4", None, NOW)], JOB_DESCRIPTIONS)
    done = texts.filter("job_id = 'BA:1'").select("job_id", F.lit("v1").alias("prompt_version"), F.lit("{}").alias("answer"), F.lit(NOW).alias("enriched_at"), content_hash(F.col("description")).alias("content_hash"), F.lit("p").alias("provider_used"))
    assert [r.job_id for r in E.queue(E.needing_answer(jobs, texts, done, "v1")).collect()] == ["BA:3"]
    assert [r.job_id for r in E.queue(E.needing_answer(jobs, texts, done, "v2"), limit=1).collect()] == ["BA:1"]
    assert E.queue(E.needing_answer(jobs, texts, enrichment, "v1"), skip=jobs.select("job_id")).count() == 0


GOOD = '{"category":"c","seniority":"s","skills_required":[],"skills_nice":["a|b "],"german_level":"B1","german_evidence":"B1 nötig","english_sufficient":true,"employment_type_norm":"minijob","duties_en":["Serve"],"requirements_en":[],"summary_en":"A job.","fit_score":50,"fit_reasons":[],"missing_for_fit":[],"red_flags":[],"application_method":"mail"}'
BAD = [("x", "not JSON"), ("[]", "not an object"), (GOOD.replace('"fit_score":50', '"fit_score":"50"'), "fit_score is not a number"), (GOOD.replace('"fit_score":50', '"fit_score":101'), "fit_score is out of range"), (GOOD.replace('"fit_score":50', '"fit_score":true'), "fit_score is not a number"), (GOOD.replace("B1 nötig", " "), "german_level without evidence"), (GOOD.replace('"B1"', '"X"'), "german_level is not one of the allowed values"), (GOOD.replace("A job.", "Wir sind ein Team und"), "summary_en is in German"), (GOOD.replace('["Serve"]', '"Serve"'), "duties_en is not a list"), (GOOD, None), (GOOD[:-1] + ',"more":1}', None), (None, "not JSON")]


def test_answers(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(BAD)], "k int, a string")
    assert [r[0] for r in df.orderBy("k").select(E.answer_problem(F.col("a"))).collect()] == [b for _, b in BAD]
    rows = spark.createDataFrame([("j", "v1", GOOD, NOW, "h", "p"), ("k", "v1", "{x", NOW, "h", "p"), ("l", "v2", GOOD, NOW, "h", "p")], ENRICHMENT)
    got = E.enriched_rows(rows, "v1").collect()
    assert len(got) == 1 and got[0].skills_nice == "a/b" and got[0].english_sufficient == "true" and got[0].hours_per_week is None and got[0].deadline == ""


def test_evidence(spark):
    df = spark.createDataFrame([("B1", "gute  Deutsch B1", "Wir wollen Gute Deutsch B1."), ("B1", "C2", "nein"), ("unclear", None, None), ("A1", "", "x"), (None, None, None)], "l string, e string, t string")
    assert [r[0] for r in df.select(E.evidence_holds(F.col("l"), F.col("e"), F.col("t"))).collect()] == [True, False, True, False, False]
