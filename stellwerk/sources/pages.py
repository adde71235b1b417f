"""Recorded answers of job sites as postings: JSON pages parsed in the JVM, whatever shape their members have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.constants import CITIES, RADIUS_KM, SEARCH_TERMS
from stellwerk.functions.html import html_text, readable_text
from stellwerk.functions.text import casefold, slug, type_signals

# What titles of the public job agency tell, and its filter code per employment type.
STUDENT_HINTS, INTERN_HINTS = ["werkstudent", "studentische hilfskraft", "hiw"], ["praktikum", "internship"]
WORKING_TIME = {"minijob": "mj", "parttime": "tz", "fulltime": "vz"}
# What the second source's job types and titles tell.
AN_TYPES = {"werkstudent": ["working student", "werkstudent"], "internship": ["intern", "praktikum"], "parttime": ["part time", "teilzeit"], "fulltime": ["full time", "vollzeit"]}
AN_TITLES = {"werkstudent": ["werkstudent", "studentische hilfskraft"], "internship": ["praktikum", "internship", "praktikant"], "parttime": ["teilzeit"], "fulltime": ["vollzeit"]}
AN_MINIJOB = ["minijob", "450 €", "520 €", "geringfügig", "geringfuegig", "aushilfe"]


def _any(text: Column, words: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


def agency_postings(pages: DataFrame, ids: list[str], payload: str = "payload") -> DataFrame:
    """Postings of the public job agency's search pages, with the page's ids and ``entry_no``.

    Entries without reference number are none; the first place counts, a single object being a list of one; any true
    member whose name begins with 'arbeitszeitTeilzeit' tells part time.
    """
    doc = F.try_parse_json(payload)
    got = lambda path, kind="string": F.try_variant_get("e", path, kind)
    place = F.coalesce(got("$.stellenlokationen[0]", "variant"), got("$.stellenlokationen", "variant"))
    at = lambda path, kind="string": F.try_variant_get("p", path, kind)
    members = F.from_json(F.to_json("e"), "map<string,string>")
    title = F.coalesce(got("$.stellenangebotsTitel"), F.lit(""))
    low = casefold(F.col("title"))
    true = lambda name: F.coalesce(F.element_at("m", name) == "true", F.lit(False))
    part = F.exists(F.map_entries("m"), lambda kv: F.startswith(kv["key"], F.lit("arbeitszeitTeilzeit")) & (kv["value"] == "true"))
    rows = (
        pages.select(*ids, F.posexplode(F.coalesce(F.try_variant_get(doc, "$.ergebnisliste", "array<variant>"), F.array(F.try_variant_get(doc, "$.ergebnisliste", "variant")))).alias("entry_no", "e"))
        .select(*ids, "entry_no", "e", got("$.referenznummer").alias("source_id"))
        .filter(F.length("source_id") > 0)
        .select("*", place.alias("p"), members.alias("m"), title.alias("title"))
    )
    raw = F.concat_ws(", ", F.when(true("arbeitszeitVollzeit"), "Vollzeit"), F.when(part, "Teilzeit"), F.when(true("istGeringfuegigeBeschaeftigung"), "Geringfügig"))
    return rows.select(
        *ids, "entry_no", F.concat(F.lit("BA:"), "source_id").alias("job_id"), F.lit("BA").alias("source"), "source_id", "title", got("$.firma").alias("company"),
        at("$.adresse.ort").alias("city"), at("$.adresse.plz").alias("plz"), at("$.breite", "double").alias("lat"), at("$.laenge", "double").alias("lon"), F.nullif(raw, F.lit("")).alias("employment_type_raw"),
        true("istGeringfuegigeBeschaeftigung").alias("is_minijob"), part.alias("is_parttime"), true("arbeitszeitVollzeit").alias("is_fulltime"), _any(low, INTERN_HINTS).alias("is_internship"), _any(low, STUDENT_HINTS).alias("is_werkstudent"),
        true("homeofficemoeglich").alias("homeoffice"), F.coalesce(got("$.veroeffentlichungszeitraum.von"), got("$.datumErsteVeroeffentlichung")).alias("published_at"), got("$.externeURL").alias("apply_url"),
    )


def board_postings(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Postings of the open board's pages ``{data: [{slug, title, ...}]}``: types from the job types, else the title."""
    schema = "struct<data:array<struct<slug:string,title:string,company_name:string,location:string,job_types:array<string>,tags:array<string>,remote:boolean,created_at:bigint,url:string,description:string>>>"
    e = pages.select(F.explode(F.from_json(payload, schema)["data"]).alias("e")).select("e.*").filter(F.length("slug") > 0)
    types = F.replace(F.replace(F.replace(casefold(F.array_join(F.coalesce("job_types", F.array().cast("array<string>")), " ")), F.lit("-"), F.lit(" ")), F.lit("fulltime"), F.lit("full time")), F.lit("parttime"), F.lit("part time"))
    title = casefold(F.coalesce("title", F.lit("")))
    flag = {k: _any(types, words) | _any(title, AN_TITLES[k]) for k, words in AN_TYPES.items()}
    return e.select(
        F.concat(F.lit("AN:"), "slug").alias("job_id"), F.lit("AN").alias("source"), F.col("slug").alias("source_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("company_name").alias("company"), F.col("location").alias("city"),
        F.nullif(F.array_join("job_types", ", "), F.lit("")).alias("employment_type_raw"), _any(title, AN_MINIJOB).alias("is_minijob"), *[c.alias(f"is_{k}") for k, c in flag.items()], F.coalesce("remote", F.lit(False)).alias("homeoffice"),
        F.when(F.col("created_at") > 0, F.timestamp_seconds("created_at")).alias("published_at"), F.col("url").alias("apply_url"), readable_text(F.col("description")).alias("description"), "tags",
    )


def matching_board(postings: DataFrame, cities: list[str], types: list[str], keywords: list[str]) -> DataFrame:
    """The open board cannot search: town, types (any of them) and keywords (in title or tags) are compared here."""
    ok = casefold(F.trim(F.coalesce("city", F.lit("")))).isin(*[c.casefold() for c in cities])
    if types:
        ok &= reduce(lambda a, b: a | b, [F.col(f"is_{t}") for t in types])
    if keywords:
        ok &= _any(casefold(F.concat_ws(" ", "title", "tags")), [k.casefold() for k in keywords])
    return postings.filter(ok)


def area_city(area: Column, wanted: list[str]) -> Column:
    """The town of an area list (country, state, town, ...): the last that was searched for, else the third, else the last."""
    parts = F.filter(area, lambda x: F.length(x) > 0)
    names = F.create_map(*[F.lit(x) for w in wanted for x in (w.casefold(), w)])
    hit = F.get(F.filter(F.transform(F.reverse(parts), lambda x: F.element_at(names, casefold(x))), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(hit, F.get(parts, F.lit(2)), F.element_at(F.when(F.size(parts) > 0, parts), -1))


def aggregator_postings(pages: DataFrame, wanted: list[str], payload: str = "payload") -> DataFrame:
    """Postings of the aggregator's pages ``{results: [...]}``; the teaser tells the types and is kept apart."""
    schema = "struct<count:bigint,results:array<struct<id:string,title:string,description:string,company:struct<display_name:string>,location:struct<area:array<string>>,latitude:double,longitude:double,category:struct<label:string>,created:string,redirect_url:string>>>"
    r = pages.select(F.explode(F.from_json(payload, schema)["results"]).alias("r")).select("r.*").filter(F.length("id") > 0)
    said = type_signals(F.col("title"), F.col("description"))
    return r.select(
        F.concat(F.lit("AZ:"), "id").alias("job_id"), F.lit("AZ").alias("source"), F.col("id").alias("source_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("company.display_name").alias("company"),
        area_city(F.col("location.area"), wanted).alias("city"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("category.label").alias("employment_type_raw"),
        *[F.array_contains(said, k).alias(f"is_{k}") for k in SEARCH_TERMS], F.col("created").alias("published_at"), F.col("redirect_url").alias("apply_url"), F.col("description").alias("teaser"),
    )


def with_text(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Postings with the best text there is: structured, readable page text of 80 characters or more, teaser."""
    d = details.select("job_id", html_text(F.col("jsonld_description")).alias("d1"), readable_text(F.col("page")).alias("d2"))
    return postings.join(d, "job_id", "left").withColumn("description", F.coalesce(F.nullif("d1", F.lit("")), "d2", "teaser")).drop("d1", "d2")


def detail_url(base: Column, reference: Column) -> Column:
    """Address of an ad at the agency: its reference number in base64."""
    return F.concat(base, F.lit("/"), F.replace(F.base64(F.encode(reference, "UTF-8")), F.lit("\r\n"), F.lit("")))


def agency_queries(cities: list[str], keywords: list[str], types: list[str], radius: int = RADIUS_KM) -> list[dict]:
    """One query per keyword, town and type: types are alternatives, never a stack; a type without filter code is a word."""
    shapes = [(None, WORKING_TIME[t]) if t in WORKING_TIME else (SEARCH_TERMS[t], None) for t in types] or [(None, None)]
    bases = [k.strip() for k in keywords if k.strip()] or [""]

    def term(base: str, word: str | None) -> str | None:
        return base if word and word in base.casefold() else " ".join(x for x in (base, word) if x) or None

    return [{"was": term(b, word), "wo": c, "umkreis": radius, "arbeitszeit": code} for b in bases for c in cities for word, code in shapes]


def board_urls(spark, base: str, cities: list[str], types: list[str], keywords: list[str]) -> DataFrame:
    """Search addresses of a site that has a page per term and town."""
    terms = list(dict.fromkeys([SEARCH_TERMS[t] for t in types] + keywords))
    rows = spark.createDataFrame([(t, c) for t in terms for c in cities], "term string, city string")
    return rows.withColumn("url", F.concat(F.lit(f"{base}/jobs/"), slug(F.col("term")), F.lit("-"), slug(F.col("city"))))


def known_city(names: DataFrame, column: str = "name") -> DataFrame:
    """Names (any column) with the entry of the city map that one of their spellings names, by an equality join."""
    from stellwerk.functions.text import spellings_of_city

    spark = names.sparkSession
    dim = spark.createDataFrame([(n, *xy) for n, xy in CITIES.items()], "city string, lat double, lon double").select("city", "lat", "lon", F.explode(spellings_of_city(F.col("city"))).alias("spelling"))
    typed = names.select(column, F.explode(spellings_of_city(F.col(column))).alias("spelling"))
    return typed.join(dim, "spelling").groupBy(column).agg(F.min(F.struct("city", "lat", "lon")).alias("c")).select(column, "c.*")
