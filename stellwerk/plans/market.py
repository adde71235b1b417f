"""Queries over postings, texts, contacts, runs and sources, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.constants import CITIES, CUISINE_LANGUAGES, FILE_ENDINGS, FOREIGN_MAIL, KIND_SCORES, LOGIN_WORDS, TYPE_WORDS
from stellwerk.functions import contact, dates, geo, html, text
from stellwerk.operators import contacts as C
from stellwerk.operators import journal as J
from stellwerk.operators import merge as M
from stellwerk.operators import profile
from stellwerk.plans import views as V
from stellwerk.session import new_folder, ship, table
from stellwerk.sources import pages as P
from stellwerk.streaming.ingest import ARRIVAL, Companion, StreamingMerge, stream_of

LANGUAGES = ["Persian", "German"]
TEMPLATES = [("bakery", "Guten Tag {place} in {city}"), ("hotel", "Hallo {place}"), ("bar", "{city}!")]


# Texts -------------------------------------------------------------------------------------------------------------
def q_dedupe_key(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", text.dedupe_key(F.col("title"), F.col("company"), F.col("city")).alias("key"))


def q_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "job_descriptions").select("job_id", text.content_hash(F.col("description")).alias("hash"))


def q_city_fold(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("city", text.identity_city(F.col("city")).alias("folded")).distinct()


def q_slugify(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", text.slug(F.col("title")).alias("slug"))


def q_type_signals(spark, sf_dir):
    return table(spark, sf_dir, "raw_postings").select("posting_no", F.array_join(text.type_signals(F.col("title"), F.col("description")), ",").alias("types"))


def q_published_on(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", dates.published_on(F.col("published_at")).alias("published_on"))


def q_german_date(spark, sf_dir):
    return table(spark, sf_dir, "job_descriptions").select("job_id", dates.german_date(F.col("description")).alias("iso"))


def q_city_plz(spark, sf_dir):
    at = text.postcode_and_city(F.concat_ws(" ", "plz", "city"))
    return table(spark, sf_dir, "jobs").select("job_id", at["plz"].alias("plz"), at["city"].alias("city"))


def _phones(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    shapes = F.array(F.concat(F.lit("+49 8431 2"), F.lpad(k, 5, "0")), F.concat(F.lit("08431/"), F.lpad(k, 6, "0")), F.concat(F.lit("004984312"), k), k, F.concat(F.lit("+49 8431 "), F.lpad(k, 4, "0"), F.lit(" (Küche 2)")), F.concat(F.lit("0841 "), F.lpad(k, 5, "0"), F.lit("; 08431 1")), F.concat(F.lit("0841 "), F.lpad(k, 5, "0"), F.lit(" oder 1")), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(shapes, (F.col("c_custkey") % 8 + 1).cast("int")).alias("raw"))


def q_phone(spark, sf_dir):
    return _phones(spark, sf_dir).select("c_custkey", "raw", contact.phone(F.col("raw")).alias("phone"))


def _markup(spark, sf_dir):
    """Pages with code, styles, tags within words, and entities of all kinds; the description is escaped as a page's text is."""
    body = F.replace(F.replace(F.coalesce("description", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return table(spark, sf_dir, "job_descriptions").select("job_id", F.concat(F.lit('<div class="a"><script>var x = "1 > 0";</script><style>p {}</style><p>'), body, F.lit("</p><p>&Uuml;ber &euro; 5 &#8211; <b>x</b>y &copy</p></div>")).alias("html"))


def q_html_text(spark, sf_dir):
    return _markup(spark, sf_dir).select("job_id", html.html_text(F.col("html")).alias("text"))


def q_readable_gate(spark, sf_dir):
    return _markup(spark, sf_dir).select("job_id", html.readable_text(F.col("html")).isNotNull().alias("readable"))


def q_login_wall(spark, sf_dir):
    page = F.when(V.mark(F.col("job_id"), 0) % 7 == 0, F.concat("html", F.lit("<form method=post action='/Login'>"))).when(V.mark(F.col("job_id"), 0) % 11 == 0, F.concat("html", F.lit("Bitte melde dich an."))).otherwise(F.col("html"))
    return _markup(spark, sf_dir).select("job_id", html.login_wall(page).alias("wall"))


def q_email(spark, sf_dir):
    page = F.when(V.mark(F.col("job_id"), 0) % 5 == 0, F.concat(F.lit("<a href=\"mailto:Chef@Laden.example?x=1\">"), "html")).otherwise(F.replace("html", F.lit("@"), F.lit(" (at) ")))
    return _markup(spark, sf_dir).select("job_id", contact.email(page).alias("email"))


def q_jsonld(spark, sf_dir):
    ship(spark)
    jobs = table(spark, sf_dir, "jobs").select("job_id", "title", "company", "city")
    block = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.array(F.struct(F.struct(F.col("city").alias("addressLocality")).alias("address"))).alias("jobLocation")))
    page = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'), block, F.lit("</script>"))
    return jobs.select("job_id", F.explode(html.jsonld_postings(page)).alias("p")).select("job_id", "p.title", "p.company", "p.city")


# Merge and streams --------------------------------------------------------------------------------------------------
def q_upsert_merge(spark, sf_dir):
    return M.merge(V.arrivals(spark, sf_dir)).select("job_id", "source", "dedupe_key", "content_hash", "apply_url", "first_seq", "last_seq")


def q_also_seen_on(spark, sf_dir):
    return M.also_seen_on(V.arrivals(spark, sf_dir))


def q_upsert_outcomes(spark, sf_dir):
    return M.outcomes(V.arrivals(spark, sf_dir))


def _streamed(spark, sf_dir) -> tuple[str, DataFrame]:
    root = new_folder(spark, "stream")
    arrivals = V.arrivals(spark, sf_dir).select(*ARRIVAL)
    arrivals.repartitionByRange(4, "seq").write.parquet(f"{root}/incoming")
    return root, stream_of(spark, f"{root}/incoming", arrivals, files=2)


def q_stream_upsert(spark, sf_dir):
    root, stream = _streamed(spark, sf_dir)
    state = StreamingMerge(spark, f"{root}/state")
    state.run(stream)
    return state.jobs().select("job_id", "source", "dedupe_key", "content_hash", "apply_url", "first_seq", "last_seq")


def _short_answer(prompts: list[str]) -> list[dict]:
    return [{"length": len(p)} for p in prompts]


def q_stream_companion(spark, sf_dir):
    ship(spark)
    root, stream = _streamed(spark, sf_dir)
    companion = Companion(spark, f"{root}/state", _short_answer)
    companion.run(stream)
    return companion.answers().select("job_id", "text_hash", F.get_json_object("answer", "$.length").cast("int").alias("length"))


# Marks, runs and health ----------------------------------------------------------------------------------------------
def _marks(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "click", "interested").when(F.col("event_type") == "purchase", "applied").when(F.col("event_type") == "error", "rejected")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"), F.when(F.col("event_type") == "view", F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("notes"))


def q_status_fold(spark, sf_dir):
    return J.status_fold(_marks(spark, sf_dir)).select("job_id", "status", "notes")


def q_applied_on(spark, sf_dir):
    return J.status_fold(_marks(spark, sf_dir)).filter("applied_on IS NOT NULL").select("job_id", "applied_on")


def _outcomes(spark, sf_dir):
    return M.outcomes(V.arrivals(spark, sf_dir), carry=["run_id", "source", "query_index", "page"])


def q_run_rollup(spark, sf_dir):
    return J.run_rollup(_outcomes(spark, sf_dir))


def q_page_counts(spark, sf_dir):
    return J.page_counts(_outcomes(spark, sf_dir))


def q_legs_merge(spark, sf_dir):
    return J.merge_legs(J.run_rollup(_outcomes(spark, sf_dir)))


def q_latest_run(spark, sf_dir):
    return J.latest_run(table(spark, sf_dir, "runs"), "search").select("run_id", "state", "found_count")


def _runs(spark, sf_dir):
    running = F.when(F.col("run_id") % 3 == 0, "running").otherwise(F.col("state"))
    return table(spark, sf_dir, "runs").withColumn("state", running).withColumn("last_progress_at", F.when(F.col("run_id") % 2 == 0, F.col("started_at") + F.make_dt_interval(mins=F.lit(5))))


RUN_NOW = "2026-02-25 15:00:00"


def q_display_state(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", J.display_state(F.col("state"), F.col("last_progress_at"), F.col("started_at"), F.lit(RUN_NOW).cast("timestamp_ntz")).alias("shown"))


def q_close_stale(spark, sf_dir):
    return J.close_stale(_runs(spark, sf_dir), F.lit(RUN_NOW).cast("timestamp_ntz")).select("run_id", "state")


def _source_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("source"), "event_id", "ts", (F.col("event_type") == "error").alias("failed"))


def q_source_health(spark, sf_dir):
    return J.source_health(_source_events(spark, sf_dir))


def q_cooldown(spark, sf_dir):
    h = J.source_health(_source_events(spark, sf_dir))
    return J.allowed_sources(h, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("source")


def q_resume_cursor(spark, sf_dir):
    spec = table(spark, sf_dir, "runs").select("run_id", F.sha1("spec").alias("spec_hash"))
    return J.resume_cursor(table(spark, sf_dir, "raw_postings").join(spec, "run_id").select("source", "spec_hash", "query_index", "page"))


def q_run_trouble(spark, sf_dir):
    runs = table(spark, sf_dir, "runs").withColumn("errors", F.when(F.col("run_id") % 2 == 0, F.lit('["BA: getaddrinfo failed"]')).otherwise(F.col("errors")))
    states = table(spark, sf_dir, "raw_postings").select("run_id", "source").distinct().withColumn("state", F.when(F.col("run_id") % 4 == 0, "failed").when(F.col("source") == "BA", "done").otherwise("skipped"))
    return J.run_trouble(runs, states)


def q_fresh_requests(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_postings")
    cache = raw.filter("posting_no % 2 = 0").select(F.sha1("source_url").alias("cache_key"), F.when(F.col("posting_no") % 3 == 0, 404).otherwise(200).alias("status"), "fetched_at")
    asked = raw.select(F.sha1("source_url").alias("cache_key")).distinct()
    return J.fresh_requests(asked, cache, F.lit("2026-02-26 10:00:00").cast("timestamp_ntz"))


def q_experience_years(spark, sf_dir):
    span = F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("start"), F.date_format(F.add_months("o_orderdate", (F.col("o_orderkey") % 30).cast("int")), "yyyy-MM").alias("end"))
    people = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.collect_list(span).alias("experience"))
    return people.select("person", profile.years_of_experience(F.col("experience"), "2026-08").alias("years"))


def q_language_level(spark, sf_dir):
    said = V.pick([*profile.LEVEL_WORDS, "b2", " C1 ", "gut"], F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", profile.language_level(said).alias("level"))


def q_role_keywords(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", F.array_join(profile.role_keywords(F.split("title", "[ /]")), "|").alias("keywords"))


# Contacts ------------------------------------------------------------------------------------------------------------
def q_places(spark, sf_dir):
    return C.places(V.elements(spark, sf_dir), "Ingolstadt").drop("tags")


def _scored(spark, sf_dir):
    p = C.places(V.elements(spark, sf_dir), "Ingolstadt")
    cuisine = F.element_at("tags", "cuisine")
    return p.withColumn("osm_id", F.col("contact_id")).withColumn("back_of_house_score", C.score(F.col("kind"), F.col("email"), cuisine, LANGUAGES)).withColumn("score_reason", C.reason(F.col("kind"), F.col("email"), cuisine, LANGUAGES)).withColumn(
        "outcome", F.when(V.mark(F.col("name"), 2) % 3 == 0, "called")
    )


def q_contact_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("osm_id", "back_of_house_score")


def q_contact_reason(spark, sf_dir):
    return _scored(spark, sf_dir).select("osm_id", "score_reason")


def q_call_list(spark, sf_dir):
    return C.call_list(_scored(spark, sf_dir), cities=["Ingolstadt"], pending=True, reachable=True).limit(10).select("osm_id", "name", "back_of_house_score")


def q_contact_counts(spark, sf_dir):
    return C.counts(_scored(spark, sf_dir))


def q_contacts_waiting(spark, sf_dir):
    return C.waiting(_scored(spark, sf_dir)).select("osm_id")


def q_template_fill(spark, sf_dir):
    return C.filled(_scored(spark, sf_dir), spark.createDataFrame(TEMPLATES, "kind string, template string"))


def q_contact_upsert(spark, sf_dir):
    s = _scored(spark, sf_dir)
    later = s.filter(V.mark(F.col("name"), 3) % 2 == 0).withColumn("phone", F.lit(None).cast("string")).withColumn("kind", F.lit("cafe"))
    both = s.withColumn("run_id", F.lit(1)).unionByName(later.withColumn("run_id", F.lit(2)))
    return C.upserted(both).select("osm_id", "name", "kind", "city", "street", "phone", "email", "website", "lat", "lon", "back_of_house_score", "first_run")


def q_contact_outcome(spark, sf_dir):
    said = F.when(F.col("event_type") == "view", "no").when(F.col("event_type") == "click", "emailed").when(F.col("event_type") == "purchase", "visited").otherwise("called")
    return C.outcomes(table(spark, sf_dir, "events").select(F.col("user_id").alias("osm_id"), "event_id", "ts", said.alias("outcome")))


# Geography and sources ------------------------------------------------------------------------------------------------
def q_radius_join(spark, sf_dir):
    centres = spark.createDataFrame([(n, *xy) for n, xy in CITIES.items()], "centre string, centre_lat double, centre_lon double")
    jobs = table(spark, sf_dir, "jobs").select("job_id", "lat", "lon")
    return geo.within_radius(jobs, centres, 25).select("job_id", "centre", F.bround("km", 6).alias("km"))


TYPED = ["münchen", "MUENCHEN", "Munchen", "nurnberg", "Würzburg", "wuerzburg", "Bonn", "Neuburg an der Donau"]


def q_city_resolve(spark, sf_dir):
    """All towns that postings name, and some spellings of towns of the map."""
    towns = [table(spark, sf_dir, t).select(F.col("city").alias("name")) for t in ("jobs", "raw_postings")]
    typed = towns[0].unionByName(towns[1]).filter("name IS NOT NULL").unionByName(spark.createDataFrame([(n,) for n in TYPED], "name string"))
    return P.known_city(typed.distinct())


def q_agency_page(spark, sf_dir):
    return P.agency_postings(table(spark, sf_dir, "jobs_werkstudent_ingolstadt"), ["page_id"]).select("page_id", "entry_no", "job_id", "title", "company", "city", "plz", "lat", "lon", "employment_type_raw", "homeoffice", "is_internship", "is_minijob", "is_parttime", "is_fulltime", "is_werkstudent", "published_at", "apply_url")


def q_board_page(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_postings").filter("source = 'AN'")
    entry = F.struct(F.col("source_id").alias("slug"), "title", F.col("company").alias("company_name"), F.col("city").alias("location"), F.array(F.when(F.col("is_fulltime"), "Full-Time").otherwise("Working Student")).alias("job_types"), F.col("homeoffice").alias("remote"), F.col("posting_no").alias("created_at"), F.col("source_url").alias("url"))
    pages = raw.select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("payload"))
    return P.board_postings(pages).select("job_id", "title", "company", "city", "is_minijob", "is_werkstudent", "is_fulltime", "homeoffice")


def q_aggregator_page(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_postings").filter("source = 'AZ'")
    entry = F.struct(F.col("source_id").alias("id"), "title", F.col("description"), F.struct(F.col("company").alias("display_name")).alias("company"), F.struct(F.array(F.lit("Deutschland"), F.lit("Bayern"), F.coalesce("city", F.lit("")), F.lit("Ortsteil")).alias("area")).alias("location"), F.col("lat").alias("latitude"))
    pages = raw.select(F.to_json(F.struct(F.array(entry).alias("results"))).alias("payload"))
    return P.aggregator_postings(pages, ["Zwiesau", "Ortsteil Nord"]).select("job_id", "title", "company", "city", "lat", "is_minijob", "is_parttime")


# SQL -----------------------------------------------------------------------------------------------------------------
_WS = r"[\s\p{Z}\x{85}]+"
_squeeze = lambda c: f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'), ' ')"
_spell = lambda c: f"replace(replace(replace(replace({c}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
_fold = lambda c: f"replace(lower({c}), 'ß', 'ss')"
_identity = lambda c: _fold(_squeeze(_spell(f"regexp_replace(coalesce({c}, ''), '(?i)\\(\\s*[mwdf](?:\\s*/\\s*[mwdf])*\\s*\\)', '', 'g')")))
_city = lambda c: _identity(f"split_part(coalesce({c}, ''), ',', 1)")
_KEY = f"sha1({_identity('title')} || '|' || {_identity('company')} || '|' || {_city('city')})"
_hash = lambda c: f"CASE WHEN length({_squeeze(c)}) > 0 THEN sha1({c}) END"
_said = f"{_fold(chr(40) + 'coalesce(title, ' + chr(39) * 2 + ') || ' + chr(39) + ' ' + chr(39) + ' || coalesce(description, ' + chr(39) * 2 + '))')}"
_SIGNALS = "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(said, {w!r})' for w in words)} THEN '{k}' END" for k, words in TYPE_WORDS.items()) + ")"
_MARKUP = "v_html AS (SELECT job_id, '<div class=\"a\"><script>var x = \"1 > 0\";</script><style>p {}</style><p>' || replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;') || '</p><p>&Uuml;ber &euro; 5 &#8211; <b>x</b>y &copy</p></div>' AS html FROM job_descriptions)"
# What a reader sees of these pages is the description and the fixed line: no markup is parsed here.
_PLAIN = _squeeze("(coalesce(description, '') || ' Über € 5 – x y ©')")
_LOGIN = " OR ".join(f"contains(lower(page), '{w}')" for w in LOGIN_WORDS)
_OWN = lambda c: "NOT (" + " OR ".join([f"contains(lower({c}), '{w}')" for w in FOREIGN_MAIL] + [f"suffix(lower({c}), '{e}')" for e in FILE_ENDINGS]) + f") AND regexp_matches({c}, '@[^@]*\\.[^@]*$')"
_PHONE = r"""v_kept AS (SELECT *, regexp_replace(regexp_replace(regexp_split_to_array(raw, '[;,]|\bor\b|\boder\b')[1], '\(.*?\)', ' ', 'g'), '[^\d+]', '', 'g') AS kept FROM v_raw),
v_full AS (SELECT *, CASE WHEN kept LIKE '+%' THEN kept WHEN kept LIKE '00%' THEN '+' || substr(kept, 3) WHEN kept LIKE '0%' THEN '+49' || substr(kept, 2) END AS f FROM v_kept)"""
_MERGE = f"""WITH v_a AS (SELECT *, posting_no AS seq, {_KEY} AS k FROM raw_postings),
v_id AS (SELECT job_id, arg_min(k, seq) AS key, arg_min(source, seq) AS src, min(seq) AS first_seq FROM v_a GROUP BY job_id),
v_own AS (SELECT key, arg_min(src, first_seq) AS owner, arg_min(job_id, first_seq) AS target FROM v_id GROUP BY key),
v_k AS (SELECT v_a.*, key, CASE WHEN src = owner THEN job_id ELSE target END AS row_id FROM v_a JOIN v_id USING (job_id) JOIN v_own USING (key)),
v_row AS (SELECT row_id, any_value(key) AS dedupe_key, arg_min_null(source, seq) FILTER (job_id = row_id) AS source, arg_min_null(description, seq) FILTER (job_id = row_id) AS own_text,
  arg_min(description, seq) FILTER (job_id != row_id AND length({_squeeze("description")}) > 0) AS other_text, arg_min_null(apply_url, seq) FILTER (job_id = row_id) AS own_url, arg_min(apply_url, seq) FILTER (job_id != row_id AND apply_url != '') AS other_url,
  min(seq) FILTER (job_id = row_id) AS first_seq, max(seq) AS last_seq FROM v_k GROUP BY row_id),
v_jobs AS (SELECT row_id AS job_id, source, dedupe_key, CASE WHEN length({_squeeze("own_text")}) > 0 THEN own_text ELSE coalesce(other_text, own_text) END AS description, CASE WHEN own_url != '' THEN own_url ELSE coalesce(other_url, own_url) END AS apply_url, first_seq, last_seq FROM v_row),
v_out AS (SELECT seq, run_id, source, query_index, page, job_id, row_id, CASE WHEN seq = first_seq THEN 'new' ELSE 'duplicate' END AS outcome FROM v_k JOIN v_row r USING (row_id, source) UNION ALL SELECT seq, run_id, v_k.source, query_index, page, job_id, row_id, 'duplicate' FROM v_k JOIN v_row r USING (row_id) WHERE v_k.source != r.source)"""
_MERGED = f"{_MERGE} SELECT job_id, source, dedupe_key, {_hash('description')} AS content_hash, apply_url, first_seq, last_seq FROM v_jobs"
_ROLL = "SELECT run_id, source, count(*) AS found, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'duplicate') AS duplicate FROM v_out GROUP BY run_id, source"
_MARKS = "v_m AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'new' WHEN 'click' THEN 'interested' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'rejected' END AS status, CASE WHEN event_type = 'view' THEN 'n' || event_id::VARCHAR END AS notes FROM events)"
_HEALTH = """v_e AS (SELECT user_id % 97 AS source, event_id, ts, event_type = 'error' AS failed FROM events),
v_g AS (SELECT source, max((ts, event_id)) AS good FROM v_e WHERE NOT failed GROUP BY source),
v_b AS (SELECT source, count(*) AS n, max(ts) AS last FROM v_e LEFT JOIN v_g USING (source) WHERE failed AND (good IS NULL OR (ts, event_id) > good) GROUP BY source),
v_h AS (SELECT source, coalesce(n, 0) AS consecutive_failures, last AS last_error_at, CASE WHEN n >= 3 THEN last + INTERVAL 24 HOUR END AS cooldown_until FROM (SELECT DISTINCT source FROM v_e) LEFT JOIN v_b USING (source))"""
_RUNS = "v_r AS (SELECT run_id, started_at, CASE WHEN run_id % 3 = 0 THEN 'running' ELSE state END AS state, CASE WHEN run_id % 2 = 0 THEN started_at + INTERVAL 5 MINUTE END AS last_progress_at FROM runs)"
_LANG = "list_extract(list_filter(list_transform(string_split(cuisine, ';'), lambda v: CASE lower(trim(v)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CUISINE_LANGUAGES.items()) + " END), lambda x: x IN ('persian', 'german')), 1)"
_BASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_SCORES.items()) + " END"
_SCORED = f"""{V.PLACES_SQL}, v_s AS (SELECT *, contact_id AS osm_id, greatest(0, least(100, coalesce({_BASE}, 15) + CASE WHEN email IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN {_LANG} IS NOT NULL THEN 6 ELSE 0 END)) AS back_of_house_score,
  {_LANG} AS language, {_BASE} AS base, CASE WHEN {V.mark_sql("name", 2)} % 3 = 0 THEN 'called' END AS outcome FROM v_place)"""
_CITY_VALUES = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in CITIES.items())
_KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - centre_lat) / 2), 2) + cos(radians(centre_lat)) * cos(radians(lat)) * pow(sin(radians(lon - centre_lon) / 2), 2)))"
_VARIANTS = lambda c: f"list_distinct([lower({c}), {_spell(f'lower({c})')}, translate(lower({c}), 'üöäß', 'uoas')])"
_E = lambda p: f"json_extract_string(e, '$.{p}')"
_PART = "(" + " OR ".join(f"coalesce({_E('arbeitszeitTeilzeit' + x)} = 'true', false)" for x in ("Abend", "Nachmittag", "Vormittag", "Flexibel")) + ")"

ORACLE = {
    "q_dedupe_key": f"SELECT job_id, {_KEY} AS key FROM jobs",
    "q_content_hash": f"SELECT job_id, {_hash('description')} AS hash FROM job_descriptions",
    "q_city_fold": f"SELECT DISTINCT city, {_city('city')} AS folded FROM jobs",
    "q_slugify": f"SELECT job_id, regexp_replace(regexp_replace(replace({_spell('lower(' + _squeeze('title') + ')')}, ' ', '-'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM jobs",
    "q_type_signals": f"SELECT posting_no, {_SIGNALS} AS types FROM (SELECT posting_no, {_said} AS said FROM raw_postings)",
    "q_published_on": f"SELECT job_id, {V.published_on_sql()} AS published_on FROM jobs",
    "q_german_date": "SELECT job_id, CASE WHEN regexp_matches(description, '\\d{2}\\.\\d{2}\\.\\d{4}') THEN regexp_replace(regexp_extract(description, '\\d{2}\\.\\d{2}\\.\\d{4}'), '(\\d{2})\\.(\\d{2})\\.(\\d{4})', '\\3-\\2-\\1') END AS iso FROM job_descriptions",
    "q_city_plz": f"SELECT job_id, nullif(regexp_extract(t, '^(\\d{{5}})\\s+', 1), '') AS plz, nullif(regexp_replace(t, '^\\d{{5}}\\s+', ''), '') AS city FROM (SELECT job_id, {_squeeze(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', plz, city)')} AS t FROM jobs)",
    "q_phone": f"WITH v_raw AS (SELECT c_custkey, list_extract(['+49 8431 2' || lpad(k, 5, '0'), '08431/' || lpad(k, 6, '0'), '004984312' || k, k, '+49 8431 ' || lpad(k, 4, '0') || ' (Küche 2)', '0841 ' || lpad(k, 5, '0') || '; 08431 1', '0841 ' || lpad(k, 5, '0') || ' oder 1', ''], c_custkey % 8 + 1) AS raw FROM (SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer)), {_PHONE} SELECT c_custkey, raw, CASE WHEN regexp_matches(f, '^\\+\\d{{9,14}}$') THEN f END AS phone FROM v_full",
    "q_html_text": f"SELECT job_id, {_PLAIN} AS text FROM job_descriptions",
    "q_readable_gate": f"SELECT job_id, length({_PLAIN}) >= 80 AS readable FROM job_descriptions",
    "q_login_wall": f"WITH {_MARKUP} SELECT job_id, ({_LOGIN}) OR regexp_matches(page, '(?i)<form[^>]+action=[\"''][^\"'']*login') AS wall FROM (SELECT job_id, CASE WHEN {V.mark_sql('job_id', 0)} % 7 = 0 THEN html || '<form method=post action=''/Login''>' WHEN {V.mark_sql('job_id', 0)} % 11 = 0 THEN html || 'Bitte melde dich an.' ELSE html END AS page FROM v_html)",
    "q_jsonld": "SELECT job_id, title, company, city FROM jobs",
    "q_email": f"WITH {_MARKUP} SELECT job_id, CASE WHEN {V.mark_sql('job_id', 0)} % 5 = 0 THEN 'chef@laden.example' ELSE lower(list_extract(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(replace(html, '@', ' (at) '), '(?i)\\s*[\\[(]\\s*(?:at|ät)\\s*[\\])]\\s*', '@', 'g'), '(?i)\\s*[\\[(]\\s*(?:dot|punkt)\\s*[\\])]\\s*', '.', 'g'), '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+'), lambda a: regexp_replace(a, '\\.+$', '')), lambda x: {_OWN('x')}), 1)) END AS email FROM v_html",
    "q_upsert_merge": _MERGED,
    "q_stream_upsert": _MERGED,
    "q_stream_companion": f"SELECT DISTINCT job_id, sha1(description) AS text_hash, length(description) AS length FROM raw_postings WHERE length({_squeeze('description')}) > 0",
    "q_also_seen_on": f"{_MERGE} SELECT row_id AS job_id, string_agg(source, ',' ORDER BY s) AS also_seen_on FROM (SELECT row_id, source, min(seq) AS s FROM v_k WHERE job_id != row_id GROUP BY row_id, source) GROUP BY row_id",
    "q_upsert_outcomes": f"{_MERGE} SELECT seq, job_id, row_id, outcome FROM v_out",
    "q_run_rollup": f"{_MERGE} {_ROLL}",
    "q_page_counts": f"{_MERGE} SELECT run_id, source, query_index, page, count(*) AS found, count(*) FILTER (outcome = 'new') AS new FROM v_out GROUP BY ALL",
    "q_legs_merge": f"{_MERGE} SELECT source, sum(found)::BIGINT AS found, sum(new)::BIGINT AS new, sum(duplicate)::BIGINT AS duplicate, count(DISTINCT run_id) AS legs FROM ({_ROLL}) GROUP BY source",
    "q_status_fold": f"WITH {_MARKS} SELECT job_id, coalesce(arg_max(status, (ts, event_id)), 'new') AS status, arg_max(notes, (ts, event_id)) AS notes FROM v_m GROUP BY job_id",
    "q_applied_on": f"WITH {_MARKS} SELECT job_id, min(ts) AS applied_on FROM v_m WHERE status = 'applied' GROUP BY job_id",
    "q_latest_run": "SELECT run_id, state, found_count FROM runs WHERE kind = 'search' ORDER BY run_id DESC LIMIT 1",
    "q_display_state": f"WITH {_RUNS} SELECT run_id, CASE WHEN state != 'running' THEN state WHEN coalesce(TIMESTAMP '{RUN_NOW}' - coalesce(last_progress_at, started_at) >= INTERVAL 10 MINUTE, true) THEN 'interrupted' ELSE 'running' END AS shown FROM v_r",
    "q_close_stale": f"WITH {_RUNS} SELECT run_id, CASE WHEN state = 'running' AND (last_progress_at IS NULL OR last_progress_at < TIMESTAMP '{RUN_NOW}' - INTERVAL 10 MINUTE) THEN 'interrupted' ELSE state END AS state FROM v_r",
    "q_source_health": f"WITH {_HEALTH} SELECT * FROM v_h",
    "q_cooldown": f"WITH {_HEALTH} SELECT source FROM v_h WHERE cooldown_until IS NULL OR TIMESTAMP '2024-01-30 12:00:00' >= cooldown_until",
    "q_resume_cursor": "SELECT source, spec_hash, w[1] AS query_index, w[2] + 1 AS next_page FROM (SELECT source, sha1(spec) AS spec_hash, max([query_index, page]) AS w FROM raw_postings JOIN runs USING (run_id) WHERE page > 0 GROUP BY 1, 2)",
    "q_run_trouble": "SELECT run_id, all_failed, all_failed AND contains(lower(e), 'getaddrinfo') AS offline FROM (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN '[\"BA: getaddrinfo failed\"]' ELSE errors END AS e FROM runs) JOIN (SELECT run_id, bool_and(run_id % 4 = 0 OR source != 'BA') AS all_failed FROM raw_postings GROUP BY run_id) USING (run_id)",
    "q_fresh_requests": "SELECT DISTINCT sha1(source_url) AS cache_key FROM raw_postings WHERE sha1(source_url) NOT IN (SELECT sha1(source_url) FROM raw_postings WHERE posting_no % 2 = 0 AND posting_no % 3 != 0 AND fetched_at > TIMESTAMP '2026-02-26 10:00:00' - INTERVAL 24 HOUR)",
    "q_experience_years": "SELECT person, round_even((max(e) - min(s)) / 12.0, 1)::DOUBLE AS years FROM (SELECT o_custkey AS person, year(o_orderdate) * 12 + month(o_orderdate) AS s, year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 30 AS e FROM orders) GROUP BY person",
    "q_language_level": "SELECT c_custkey, list_extract([" + ", ".join(f"'{v}'" for v in [*profile.LEVEL_WORDS.values(), "B2", "C1"]) + f", NULL], c_custkey % {len(profile.LEVEL_WORDS) + 3} + 1) AS level FROM customer",
    "q_role_keywords": "SELECT job_id, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(list_transform(regexp_split_to_array(title, '[ /]'), lambda k: lower(trim(k, ' '))), lambda k: length(k) > 0), lambda k: [k])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), '|') AS keywords FROM jobs",
    "q_places": f"WITH {V.PLACES_SQL} SELECT contact_id, name, kind, city, street, phone, email, website, lat, lon FROM v_place",
    "q_contact_score": f"WITH {_SCORED} SELECT osm_id, back_of_house_score FROM v_s",
    "q_contact_reason": f"WITH {_SCORED} SELECT osm_id, concat_ws(', ', 'A ' || replace(kind, '_', ' ') || CASE WHEN base IS NULL THEN ' — not a kind we know much about' WHEN base >= 70 THEN ': mostly back-of-house work' WHEN base >= 45 THEN ': some kitchen work, some customer contact' ELSE ': mostly serving customers' END, CASE WHEN email IS NOT NULL THEN 'you can write instead of phoning' END, CASE WHEN language IS NOT NULL THEN 'their kitchen may speak ' || upper(language[1]) || language[2:] END) || '.' AS score_reason FROM v_s",
    "q_call_list": f"WITH {_SCORED} SELECT osm_id, name, back_of_house_score FROM v_s WHERE outcome IS NULL AND coalesce(phone, email) IS NOT NULL ORDER BY back_of_house_score DESC, lower(name), osm_id LIMIT 10",
    "q_contact_counts": f"WITH {_SCORED} SELECT count(*) AS total, count(*) FILTER (coalesce(phone, email) IS NOT NULL) AS reachable, count(*) FILTER (outcome IS NULL) AS pending FROM v_s",
    "q_contacts_waiting": f"WITH {_SCORED} SELECT osm_id FROM v_s WHERE phone IS NULL AND email IS NULL AND website IS NOT NULL",
    "q_template_fill": f"WITH {_SCORED} SELECT osm_id, kind, replace(replace(template, '{{place}}', name), '{{city}}', city) AS script FROM v_s JOIN (VALUES {', '.join(f'({k!r}, {t!r})' for k, t in TEMPLATES)}) t(kind, template) USING (kind)",
    "q_contact_upsert": f"WITH {_SCORED} SELECT osm_id, name, CASE WHEN {V.mark_sql('name', 3)} % 2 = 0 THEN 'cafe' ELSE kind END AS kind, city, street, phone, email, website, lat, lon, back_of_house_score, 1 AS first_run FROM v_s",
    "q_contact_outcome": "SELECT osm_id, arg_max(outcome, (ts, event_id)) AS outcome, min(ts) FILTER (outcome != 'no') AS last_contacted_at FROM (SELECT user_id AS osm_id, event_id, ts, CASE event_type WHEN 'view' THEN 'no' WHEN 'click' THEN 'emailed' WHEN 'purchase' THEN 'visited' ELSE 'called' END AS outcome FROM events) GROUP BY osm_id",
    "q_radius_join": f"SELECT job_id, centre, round_even({_KM}, 6) AS km FROM jobs, (VALUES {_CITY_VALUES}) c(centre, centre_lat, centre_lon) WHERE {_KM} <= 25",
    "q_city_resolve": f"SELECT name, min(c.city) AS city, min(lat) AS lat, min(lon) AS lon FROM (SELECT city AS name FROM jobs WHERE city IS NOT NULL UNION SELECT city FROM raw_postings WHERE city IS NOT NULL UNION SELECT * FROM (VALUES {', '.join(f'({n!r})' for n in TYPED)})) n(name), (VALUES {_CITY_VALUES}) c(city, lat, lon) WHERE list_has_any({_VARIANTS('name')}, {_VARIANTS('c.city')}) GROUP BY name",
    "q_agency_page": f"WITH v_p AS (SELECT page_id, json_extract(payload, '$.ergebnisliste[*]') AS es FROM jobs_werkstudent_ingolstadt WHERE json_valid(payload)), v_e AS (SELECT page_id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS entry_no FROM v_p) SELECT page_id, entry_no::INT AS entry_no, 'BA:' || {_E('referenznummer')} AS job_id, coalesce({_E('stellenangebotsTitel')}, '') AS title, {_E('firma')} AS company, json_extract_string(pl, '$.adresse.ort') AS city, json_extract_string(pl, '$.adresse.plz') AS plz, try_cast(json_extract_string(pl, '$.breite') AS DOUBLE) AS lat, try_cast(json_extract_string(pl, '$.laenge') AS DOUBLE) AS lon, nullif(concat_ws(', ', CASE WHEN {_E('arbeitszeitVollzeit')} = 'true' THEN 'Vollzeit' END, CASE WHEN {_PART} THEN 'Teilzeit' END, CASE WHEN {_E('istGeringfuegigeBeschaeftigung')} = 'true' THEN 'Geringfügig' END), '') AS employment_type_raw, coalesce({_E('homeofficemoeglich')} = 'true', false) AS homeoffice, contains(lower(coalesce({_E('stellenangebotsTitel')}, '')), 'praktikum') OR contains(lower(coalesce({_E('stellenangebotsTitel')}, '')), 'internship') AS is_internship, coalesce({_E('istGeringfuegigeBeschaeftigung')} = 'true', false) AS is_minijob, {_PART} AS is_parttime, coalesce({_E('arbeitszeitVollzeit')} = 'true', false) AS is_fulltime, contains(lower(coalesce({_E('stellenangebotsTitel')}, '')), 'werkstudent') OR contains(lower(coalesce({_E('stellenangebotsTitel')}, '')), 'studentische hilfskraft') OR contains(lower(coalesce({_E('stellenangebotsTitel')}, '')), 'hiw') AS is_werkstudent, coalesce({_E('veroeffentlichungszeitraum.von')}, {_E('datumErsteVeroeffentlichung')}) AS published_at, {_E('externeURL')} AS apply_url FROM (SELECT *, coalesce(CASE WHEN json_type(e, '$.stellenlokationen[0]') != 'NULL' THEN json_extract(e, '$.stellenlokationen[0]') END, CASE WHEN json_type(e, '$.stellenlokationen') = 'OBJECT' THEN json_extract(e, '$.stellenlokationen') END) AS pl FROM v_e) WHERE length({_E('referenznummer')}) > 0",
    "q_board_page": "SELECT job_id, title, company, city, (contains(t, 'minijob') OR contains(t, '450 €') OR contains(t, '520 €') OR contains(t, 'geringfügig') OR contains(t, 'geringfuegig') OR contains(t, 'aushilfe')) AS is_minijob, NOT is_fulltime OR contains(t, 'werkstudent') OR contains(t, 'studentische hilfskraft') AS is_werkstudent, is_fulltime OR contains(t, 'vollzeit') AS is_fulltime, coalesce(homeoffice, false) AS homeoffice FROM (SELECT *, lower(coalesce(title, '')) AS t FROM raw_postings WHERE source = 'AN')",
    "q_aggregator_page": f"SELECT job_id, title, company, CASE WHEN lower(city) = 'zwiesau' THEN 'Zwiesau' WHEN coalesce(city, '') = '' THEN 'Ortsteil' ELSE city END AS city, lat, contains(',' || types || ',', ',minijob,') AS is_minijob, contains(',' || types || ',', ',parttime,') AS is_parttime FROM (SELECT *, {_SIGNALS} AS types FROM (SELECT *, {_said} AS said FROM raw_postings WHERE source = 'AZ'))",
}


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return ORACLE
