"""Queries over recorded pages of sites, the applicant's side and the run journal, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.constants import CITIES, IMPRINT_PATHS, SOURCES, TYPE_FLAGS
from stellwerk.functions import contact, dates
from stellwerk.operators import contacts as C
from stellwerk.operators import journal as J
from stellwerk.operators import listing as L
from stellwerk.operators import profile
from stellwerk.plans import market as K
from stellwerk.plans import views as V
from stellwerk.session import ship, table
from stellwerk.sources import markup, pages, recorded

FLAGS = list(TYPE_FLAGS.values())


def _escaped(text: Column) -> Column:
    """Text as a page writes it."""
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# Sites ---------------------------------------------------------------------------------------------------------------
def q_agency_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agency's queries for all towns of the list, two keywords and four types."""
    # The reference list of towns has a fixed number of entries.
    towns = [r[0] for r in table(spark, sf_dir, "ref_cities").select("name").collect()]
    rows = pages.agency_queries(towns, ["Küche", "Teilzeit Lager"], ["minijob", "parttime", "werkstudent", "internship"])
    return spark.createDataFrame([(q["was"], q["wo"], q["umkreis"], q["arbeitszeit"]) for q in rows], "was string, wo string, umkreis int, arbeitszeit string")


def q_detail_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").select("job_id", pages.detail_url(F.lit("https://agency.example/jobdetails"), F.col("source_id")).alias("url"))


def q_ad_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each description: structured text for some jobs, a page for others, and the posting's title as teaser."""
    kind = V.mark(F.col("job_id"), 0) % 3
    body = F.concat(F.lit("<p>"), _escaped(F.col("description")), F.lit("</p>"))
    details = table(spark, sf_dir, "job_descriptions").select("job_id", F.when(kind == 0, body).alias("jsonld_description"), F.when(kind == 1, F.concat(F.lit("<html><style>a {}</style>"), body, F.lit("</html>"))).alias("page"))
    return pages.with_text(table(spark, sf_dir, "jobs").select("job_id", F.col("title").alias("teaser")), details).select("job_id", "description")


def q_link_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ten links each, some of them no posting's, some with a label instead of a text."""
    ship(spark)
    title = _escaped(F.col("title"))
    link = F.when(F.col("posting_no") % 7 == 0, F.concat(F.lit('<a href="/about">'), title, F.lit("</a>"))).when(
        F.col("posting_no") % 2 == 0, F.concat(F.lit('<a href="/jobs/x-'), F.col("posting_no"), F.lit('"><b>'), title, F.lit("</b></a>"))
    ).otherwise(F.concat(F.lit('<a aria-label="'), F.replace(title, F.lit('"'), F.lit("&quot;")), F.lit('" href="/jobs/x-'), F.col("posting_no"), F.lit('">go</a>')))
    lists = table(spark, sf_dir, "raw_postings").groupBy(F.floor(F.col("posting_no") / 10).alias("page")).agg(F.array_join(F.collect_list(link), "\n").alias("html"))
    return markup.link_postings(lists, "XI", "https://site.example").select("job_id", "title", "source_url", *FLAGS)


def q_card_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each arrival; every ninth is a request, which is none."""
    ship(spark)
    n = F.col("posting_no").cast("string")
    path = F.when(F.col("posting_no") % 9 == 0, "/s-gesuch/").otherwise("/s-anzeige/")
    card = F.concat(
        F.lit('<article class="aditem" data-adid="'), n, F.lit('" data-href="'), path, n, F.lit('"><h2><a class="ellipsis">'), _escaped(F.col("title")), F.lit('</a></h2><div class="aditem-main--top--left"> '),
        F.coalesce("plz", F.lit("")), F.lit(" "), _escaped(F.col("city")), F.lit('</div><p class="aditem-main--middle--description">'), _escaped(F.col("description")), F.lit("</p></article>"),
    )
    return markup.card_postings(table(spark, sf_dir, "raw_postings").select(card.alias("html")), "https://site.example").select("source_id", "title", "source_url", *FLAGS)


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_postings").select("posting_no", "title", "city", F.array(F.col("company")).alias("tags"), *FLAGS)


def q_board_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.matching_board(_board(spark, sf_dir), ["ZWIESAU", "Buchenberg"], ["minijob", "werkstudent"], ["lager", "Küche", "gmbh"]).select("posting_no")


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imprint pages of all places: the first that answers is not always the first that is tried."""
    p = _websites(spark, sf_dir).select("contact_id", "website", "n")
    paths = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("path")) for k, x in enumerate(IMPRINT_PATHS)]))
    page = F.concat(F.lit("<p>Kontakt: info (at) haus"), F.col("n"), F.lit("-"), F.col("p.k"), F.lit(" (dot) example</p>"))
    return p.withColumn("p", paths).select(F.concat(F.lit("https://haus"), F.col("n"), F.lit(".example"), F.col("p.path")).alias("url"), F.when((F.col("n") + F.col("p.k")) % 3 == 0, 200).otherwise(404).alias("status"), page.alias("html"))


def _websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    site = F.concat(F.when(n % 2 == 0, "HTTPS://haus").otherwise("haus"), n, F.lit(".example/start?x=1"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("node/"), n).alias("contact_id"), n.alias("n"), F.when(n % 5 == 0, "0841 1").alias("phone"), F.when(n % 7 == 0, "").alias("email"), site.alias("website"))


def q_imprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.imprint_mail(_websites(spark, sf_dir), _fetched(spark, sf_dir))


def q_site_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _websites(spark, sf_dir).select("contact_id", contact.site_root(F.col("website")).alias("root"))


def q_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(recorded.registry(keys={}), "source string, kind string, skipped string")


def q_city_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a contacts run by town: how many, how many new, and which kinds."""
    p = C.places(V.elements(spark, sf_dir), V.pick(["Ingolstadt", "Erlangen"], F.col("id").cast("int")))
    known = p.filter(V.mark(F.col("name"), 3) % 4 == 0).select("contact_id")
    return C.by_city(p, known).withColumn("kinds", F.array_join("kinds", ","))


def q_tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two servers to the tag queries: the second is asked where the first failed; a place counts once."""
    e = V.elements(spark, sf_dir)
    rank = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(t).alias("tag")) for k, t in enumerate(C.TAGS)]))
    answers = e.withColumn("q", rank).filter((F.col("id") % len(C.TAGS) == F.col("q.rank")) | (F.col("id") % 4 == 0)).select(F.col("q.tag").alias("tag"), (F.col("q.rank") % 3).alias("server"), "type", "id", "lat", "lon", "center", "tags")
    return C.scanned(answers)[0].select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("osm_id"), "tag")


def q_failed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "nation").select(F.element_at(F.array(*map(F.lit, C.TAGS)), (F.col("n_nationkey") % len(C.TAGS) + 1).cast("int")).alias("tag"), (F.col("n_nationkey") % 2).cast("int").alias("server"), (F.col("n_nationkey") % 5 == 0).alias("answered"))
    return C.failed_tags(asked)


# The applicant ---------------------------------------------------------------------------------------------------------
def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    word = lambda p: F.concat(F.lit(p), k)
    job = lambda a, b: F.struct(word("Job").alias("title"), word("Firm").alias("company"), a.alias("start"), b.alias("end"))
    year = (F.lit(2000) + k % 20).cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit(" "), F.col("c_name"), F.lit(" X")).alias("name"),
        F.array(job(F.concat(year, F.lit("-03")), F.concat(year, F.lit("-11"))), job(F.when(k % 3 == 0, "YYYY-MM").otherwise("2021-13"), F.lit("present"))).alias("experience"), F.array(F.struct(word("Deg").alias("degree"), word("Uni").alias("school"))).alias("education"),
        F.array(F.struct(F.lit("English").alias("name"), F.lit("fluent").alias("level")), F.struct(F.when(k % 4 == 0, "Deutsch").when(k % 4 == 1, "German (learning)").otherwise("Persian").alias("name"), V.pick(["b1", "fließend", "???"], k).alias("level"))).alias("languages"),
        F.map_from_arrays(F.array(F.lit("Tools"), F.lit("Code"), F.lit("Art"), F.lit("Zoo")), F.array(F.array(word("t")), F.array(F.lit("a"), word("c")), F.when(k % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))), F.array(F.lit("z")))).alias("skill_groups"),
    )


def q_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.digest(_resumes(spark, sf_dir), ["c_custkey"])


def q_resume_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumes(spark, sf_dir).select("c_custkey", profile.years_of_experience(F.col("experience"), "2026-08").alias("years"))


def q_skill_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumes(spark, sf_dir).select("c_custkey", F.array_join(profile.top_skill_groups(F.col("skill_groups")), ",").alias("groups"))


def q_own_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumes(spark, sf_dir).select("c_custkey", profile.own_german_level(F.col("languages")).alias("level"))


def q_first_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumes(spark, sf_dir).select("c_custkey", profile.first_name(F.when(F.col("c_custkey") % 6 != 0, F.col("name"))).alias("first_name"))


def q_stored_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit("{no json")).otherwise(F.concat(F.lit('{"roles": [{"title_de": "Rolle '), k, F.lit('", "title_en": "Role", "search_keywords": [" A'), k, F.lit('", "b", "B "], "confidence": 0.5}, {"title_de": "Zweite '), k, F.lit('"}]}')))
    return profile.stored_roles(table(spark, sf_dir, "part").select(text.alias("value"))).select("title_de", "title_en", F.array_join("search_keywords", "|").alias("keywords"), "confidence")


def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt files of several versions; the highest number counts, not the last by name."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("prompts/task"), k % 40, F.lit(".v"), F.floor(k / 40), F.when(k % 13 == 0, ".txt").otherwise(".md"))
    return profile.latest_prompts(table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_name").alias("text")))


def q_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = '{"de": "Hallo", "en": "Hello"}'
    mail = '"email_subject": "Arbeit", "email_body": "An {place}"'
    cases = [f'{{"script_lines": [{", ".join([line] * 5)}], {mail}}}', f'{{"script_lines": [{", ".join([line] * 4)}], {mail}}}', f"{{{mail}}}", "{no json", f'{{"script_lines": [{", ".join([line] * 4)}, {{"de": " ", "en": "x"}}], {mail}}}']
    cases += [f'{{"script_lines": [{", ".join([line] * 5)}], "email_subject": " ", "email_body": "An {{place}}"}}', f'{{"script_lines": [{", ".join([line] * 5)}], "email_subject": "a", "email_body": "An alle"}}']
    return table(spark, sf_dir, "supplier").select("s_suppkey", profile.script_problem(V.pick(cases, F.col("s_suppkey"))).alias("problem"))


# Lists and the journal ---------------------------------------------------------------------------------------------------
def q_contacts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond the end is the last one."""
    return C.page(C.call_list(K._scored(spark, sf_dir)), 1_000_000).select("osm_id")


def q_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").groupBy("source").agg(F.count("*").alias("n"))
    return jobs.select("source", L.page_count(F.col("n")).alias("pages"))


def q_filters_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [{"status": ["new", "applied", "new", "gone"], "min_fit": "60"}, {"city": "Zwiesau", "type": ["minijob", "x"], "max_german": "B1", "page": "-3"}, {"min_fit": "101", "posted_within": "7", "sort": "size"}, {"posted_within": "8"}]
    return spark.createDataFrame([(k, L.describe(L.parse_filters(a))) for k, a in enumerate(asked)], "request int, words string")


def q_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "runs")
    now = F.when(F.col("run_id") % 2 == 0, F.coalesce("finished_at", "started_at")).otherwise(F.col("started_at") + F.make_dt_interval(mins=F.lit(7)))
    return r.select("run_id", dates.rate_per_minute(F.col("found_count"), F.col("started_at"), now).alias("rate"))


def q_resumable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the newest searches the first that was interrupted and has arrivals to go on from."""
    runs = table(spark, sf_dir, "runs").withColumn("state", F.when(F.col("run_id") % 3 != 0, "interrupted").otherwise(F.col("state"))).withColumn("kind", F.lit("search"))
    found = table(spark, sf_dir, "raw_postings").filter("page > 2").select("run_id").distinct()
    return J.resumable_run(runs, found).select("run_id")


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "finish").otherwise("progress")
    return e.select((F.col("user_id") % 50).alias("run_id"), "event_id", "ts", what.alias("what"), (F.col("event_id") % 9).alias("found"), (F.col("event_id") % 4).alias("new"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id") % 3)).alias("error"))


def q_run_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = J.runs_of(_journal(spark, sf_dir))
    return r.select("run_id", "state", "started_at", "last_progress_at", "finished_at", "found_count", "new_count", F.array_join("errors", ";").alias("errors"))


def q_refused_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of unknown jobs and of no known status are refused, with the reason."""
    said = V.pick(["new", "applied", "gone", "rejected"], F.col("posting_no").cast("int"))
    marks = table(spark, sf_dir, "raw_postings").select(F.col("posting_no").alias("event_id"), "job_id", said.alias("status"))
    return J.refused_marks(marks, table(spark, sf_dir, "jobs")).select("event_id", "reason")


def q_cache_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stellwerk.operators import enrichment as E

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("answer"))
    return E.cache_after(p.filter("key % 2 = 0"), p.filter("key % 3 = 0").withColumn("answer", F.lit("new")), p.filter("key % 5 = 0"))


# SQL -----------------------------------------------------------------------------------------------------------------
_sq = K._squeeze
_T = lambda c: f"{_sq(f'coalesce({c}, ' + repr('') + ')')}"
_flags = lambda types: ", ".join(f"contains(',' || {types} || ',', ',{k},') AS {f}" for k, f in TYPE_FLAGS.items())
_SAID = lambda a: K._fold(a)
_TITLE_TYPES = f"(SELECT {K._SIGNALS} FROM (SELECT {K._fold(_T('title'))} AS said))"
_CARD_TYPES = f"(SELECT {K._SIGNALS} FROM (SELECT {K._fold(_T('title') + ' || chr(32) || ' + _T('description'))} AS said))"
_PLAIN = lambda c: f"nullif({_sq(c)}, '')"
_TAGLIST = ", ".join(f"'{t}'" for t in C.TAGS)
_WEB = "v_w AS (SELECT c_custkey AS n, 'node/' || c_custkey AS contact_id, CASE WHEN c_custkey % 5 = 0 THEN '0841 1' END AS phone FROM customer)"
_PATH_VALUES = ", ".join(f"({k}, '{p}')" for k, p in enumerate(IMPRINT_PATHS))

ORACLE = {
    "q_agency_queries": "SELECT CASE WHEN w IS NULL OR (k = 'Teilzeit Lager' AND w = 'teilzeit') THEN k ELSE k || ' ' || w END AS was, name AS wo, 25 AS umkreis, c AS arbeitszeit FROM ref_cities, (VALUES ('Küche'), ('Teilzeit Lager')) a(k), (VALUES (NULL, 'mj'), (NULL, 'tz'), ('werkstudent', NULL), ('praktikum', NULL)) b(w, c)",
    "q_detail_url": "SELECT job_id, 'https://agency.example/jobdetails/' || to_base64(encode(source_id)) AS url FROM jobs",
    "q_ad_text": f"SELECT job_id, coalesce(CASE WHEN k = 0 THEN {_PLAIN('description')} WHEN k = 1 AND length({_sq('description')}) >= 80 THEN {_sq('description')} END, title) AS description FROM (SELECT j.job_id, j.title, d.description, {V.mark_sql('j.job_id', 0)} % 3 AS k FROM jobs j LEFT JOIN job_descriptions d USING (job_id))",
    "q_link_postings": f"SELECT 'XI:x-' || posting_no AS job_id, CASE WHEN posting_no % 2 = 0 THEN {_T('title')} ELSE coalesce(title, '') END AS title, 'https://site.example/jobs/x-' || posting_no AS source_url, {_flags(_TITLE_TYPES)} FROM raw_postings WHERE posting_no % 7 != 0 AND length({_T('title')}) > 0",
    "q_card_postings": f"SELECT posting_no::VARCHAR AS source_id, {_T('title')} AS title, 'https://site.example/s-anzeige/' || posting_no AS source_url, {_flags(_CARD_TYPES)} FROM raw_postings WHERE posting_no % 9 != 0 AND length({_T('title')}) > 0",
    "q_board_match": "SELECT posting_no FROM raw_postings WHERE lower(trim(coalesce(city, ''), ' ')) IN ('zwiesau', 'buchenberg') AND (is_minijob OR is_werkstudent) AND regexp_matches(replace(lower(concat_ws(' ', title, company)), 'ß', 'ss'), 'lager|küche|gmbh')",
    "q_imprint": f"WITH {_WEB} SELECT contact_id, 'info@haus' || n || '-' || min(k) || '.example' AS email FROM v_w, (VALUES {_PATH_VALUES}) p(k, path) WHERE phone IS NULL AND (n + k) % 3 = 0 GROUP BY contact_id, n",
    "q_site_root": f"WITH {_WEB} SELECT contact_id, 'https://haus' || n || '.example' AS root FROM v_w",
    "q_registry": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}', {'NULL' if s not in ('AZ', 'SS', 'ID') else repr('no key') if s == 'AZ' else repr('off by default')})" for s, k in SOURCES.items()) + ") t(source, kind, skipped)",
    "q_city_places": f"WITH {V.PLACES_SQL}, v_c AS (SELECT *, list_extract(['Ingolstadt', 'Erlangen'], c_custkey % 2 + 1) AS town FROM v_place) SELECT town AS city, count(*) AS places, count(*) FILTER ({V.mark_sql('name', 3)} % 4 != 0) AS new_places, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM v_c GROUP BY town",
    "q_tag_scan": f"SELECT 'node/' || c_custkey AS osm_id, list_extract([{_TAGLIST}], CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE c_custkey % {len(C.TAGS)} + 1 END) AS tag FROM customer",
    "q_failed_tags": f"SELECT tag FROM (SELECT list_extract([{_TAGLIST}], n_nationkey % {len(C.TAGS)} + 1) AS tag, n_nationkey % 5 = 0 AS answered FROM nation) GROUP BY tag HAVING NOT bool_or(answered)",
    "q_digest": "SELECT c_custkey, '# Skills' || chr(10) || '- Art: ' || CASE WHEN c_custkey % 2 = 0 THEN 'x, y' ELSE 'x' END || chr(10) || '- Code: a, c' || c_custkey || chr(10) || '- Tools: t' || c_custkey || chr(10) || '- Zoo: z' || chr(10) || '# Education' || chr(10) || '- Deg' || c_custkey || ', Uni' || c_custkey || chr(10) || '# Experience' || chr(10) || '- Job' || c_custkey || ' at Firm' || c_custkey || ' (' || (2000 + c_custkey % 20) || '-03 to ' || (2000 + c_custkey % 20) || '-11)' || chr(10) || '- Job' || c_custkey || ' at Firm' || c_custkey || ' (' || CASE WHEN c_custkey % 3 = 0 THEN 'YYYY-MM' ELSE '2021-13' END || ' to present)' || chr(10) || '# Languages' || chr(10) || '- English: fluent' || chr(10) || '- ' || CASE c_custkey % 4 WHEN 0 THEN 'Deutsch' WHEN 1 THEN 'German (learning)' ELSE 'Persian' END || ': ' || list_extract(['b1', 'fließend', '???'], c_custkey % 3 + 1) AS digest FROM customer",
    "q_resume_years": "SELECT c_custkey, round_even((2026 * 12 + 8 - (2000 + c_custkey % 20) * 12 - 3) / 12.0, 1)::DOUBLE AS years FROM customer",
    "q_skill_groups": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Code,Art,Tools' ELSE 'Code,Tools,Art' END AS groups FROM customer",
    "q_own_level": "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN list_extract(['B1', 'C1', 'A2'], c_custkey % 3 + 1) ELSE 'A2' END AS level FROM customer",
    "q_first_name": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'a student' ELSE split_part(c_name, ' ', 1) END AS first_name FROM customer",
    "q_stored_roles": "SELECT 'Rolle ' || p_partkey AS title_de, 'Role' AS title_en, 'a' || p_partkey || '|b' AS keywords, 0.5::DOUBLE AS confidence FROM part WHERE p_partkey % 5 != 0 UNION ALL SELECT 'Zweite ' || p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 5 != 0",
    "q_prompts": "SELECT 'task' || (p_partkey % 40) AS name, 'v' || max(p_partkey // 40) AS version, arg_max(p_name, p_partkey // 40) AS text FROM part WHERE p_partkey % 13 != 0 GROUP BY p_partkey % 40",
    "q_scripts": "SELECT s_suppkey, list_extract([NULL, 'not 5 lines', 'not 5 lines', 'not 5 lines', 'a line lacks a language', 'no subject or no body', 'no place for the name'], s_suppkey % 7 + 1) AS problem FROM supplier",
    "q_contacts_page": f"WITH {K._SCORED}, v_n AS (SELECT osm_id, row_number() OVER (ORDER BY back_of_house_score DESC, lower(name), osm_id) AS r, count(*) OVER () AS n FROM v_s) SELECT osm_id FROM v_n WHERE r > (n - 1) // 20 * 20",
    "q_list_pages": "SELECT source, ((count(*) + 49) // 50)::INT AS pages FROM jobs GROUP BY source",
    "q_filters_in_words": "SELECT * FROM (VALUES (0, 'new or applied; fit 60 or more'), (1, 'minijob; Zwiesau; German up to B1'), (2, 'posted in the last 7 days'), (3, '')) t(request, words)",
    "q_rate": "SELECT run_id, CASE WHEN s > 0 THEN round_even(found_count / (s / 60.0), 0)::INT END AS rate FROM (SELECT run_id, found_count, greatest(0, datediff('second', date_trunc('second', started_at), CASE WHEN run_id % 2 = 0 THEN coalesce(finished_at, started_at) ELSE started_at + INTERVAL 7 MINUTE END)) AS s FROM runs)",
    "q_resumable_run": "SELECT run_id FROM (SELECT run_id, CASE WHEN run_id % 3 != 0 THEN 'interrupted' ELSE state END AS state FROM runs ORDER BY run_id DESC LIMIT 20) WHERE state = 'interrupted' AND run_id IN (SELECT run_id FROM raw_postings WHERE page > 2) ORDER BY run_id DESC LIMIT 1",
    "q_run_journal": """WITH e AS (SELECT user_id % 50 AS run_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' ELSE 'progress' END AS what, event_id % 9 AS found, event_id % 4 AS new, CASE WHEN event_type = 'error' THEN 'E' || event_id % 3 END AS error FROM events)
SELECT run_id, CASE WHEN max((ts, event_id)) FILTER (what = 'finish') > max((ts, event_id)) FILTER (what = 'start') OR (count(*) FILTER (what = 'start') = 0 AND count(*) FILTER (what = 'finish') > 0) THEN 'done' ELSE 'running' END AS state, max(ts) FILTER (what = 'start') AS started_at, max(ts) FILTER (what = 'progress') AS last_progress_at,
  CASE WHEN max((ts, event_id)) FILTER (what = 'finish') > max((ts, event_id)) FILTER (what = 'start') OR count(*) FILTER (what = 'start') = 0 THEN max(ts) FILTER (what = 'finish') END AS finished_at, coalesce(sum(found) FILTER (what = 'progress'), 0)::BIGINT AS found_count, coalesce(sum(new) FILTER (what = 'progress'), 0)::BIGINT AS new_count, coalesce(string_agg(DISTINCT error, ';' ORDER BY error), '') AS errors FROM e GROUP BY run_id""",
    "q_refused_marks": "SELECT posting_no AS event_id, CASE WHEN posting_no % 4 = 2 THEN 'unknown status' ELSE 'unknown job' END AS reason FROM raw_postings WHERE posting_no % 4 = 2 OR job_id NOT IN (SELECT job_id FROM jobs)",
    "q_cache_after": "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS answer FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 5 != 0",
}


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return ORACLE
