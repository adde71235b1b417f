"""The applicant's side: language levels, experience, digest, suggested roles, prompt versions, scripts.

All of it is small, but expressed as columns over one-row tables of nested structs, so that it can be joined with jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.constants import LEVELS

# Words for language levels.
LEVEL_WORDS = {"mother tongue": "C2", "native": "C2", "native proficiency": "C2", "muttersprache": "C2", "fluent": "C1", "fließend": "C1", "advanced": "C2", "intermediate": "B1", "basic": "A2", "beginner": "A1", "grundkenntnisse": "A2"}
SCRIPT_LINES = 5


def language_level(raw: Column, strict: bool = False) -> Column:
    """A level as written or by its word; anything else is null, or an error if ``strict``."""
    clean = F.trim(raw)
    word = F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL_WORDS.items() for x in kv]), F.lower(clean))
    level = F.coalesce(F.when(F.upper(clean).isin(*LEVELS[1:]), F.upper(clean)), word)
    return F.coalesce(level, F.raise_error(F.concat(F.lit("unknown language level: "), F.coalesce(clean, F.lit("none"))))) if strict else level


def own_german_level(languages: Column) -> Column:
    """The level of the first language that is German and has a known level; A2 without one."""
    german = F.filter(languages, lambda x: (F.contains(F.lower(x["name"]), F.lit("german")) | F.contains(F.lower(x["name"]), F.lit("deutsch"))) & language_level(x["level"]).isNotNull())
    return F.coalesce(language_level(F.get(german, F.lit(0))["level"]), F.lit("A2"))


def months(text: Column, now: str) -> Column:
    """Months since year 0 of 'yyyy-MM' or 'present' (which is ``now``); placeholders and bad months are null."""
    clean = F.when(text == "present", F.lit(now)).otherwise(text)
    month = F.regexp_extract(clean, r"^(\d{4})-(\d{2})$", 2).try_cast("int")
    return F.when(month.between(1, 12), F.regexp_extract(clean, r"^(\d{4})-(\d{2})$", 1).try_cast("int") * 12 + month)


def years_of_experience(experience: Column, now: str) -> Column:
    """From the earliest start to the latest end, in years, rounded half to even; 0 where either is missing."""
    at = lambda f: F.transform(experience, lambda x: months(x[f], now))
    return F.coalesce(F.bround((F.array_max(at("end")) - F.array_min(at("start"))) / 12, 1), F.lit(0.0))


def top_skill_groups(groups: Column, n: int = 3) -> Column:
    """Names of the largest skill groups; groups alike in size stay in the order of the resume."""
    ranked = F.array_sort(F.transform(F.map_entries(groups), lambda e, i: F.struct((-F.size(e["value"])).alias("k"), i.alias("i"), e["key"].alias("name"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["name"])


def first_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(F.trim(name), F.lit(" "), F.lit(1)), F.lit("")), F.lit("a student"))


def digest(resume: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """(ids, digest): what a model may see of a resume; name, address and numbers are not among it."""
    head = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"# {title}\n"), F.array_join(lines, "\n")))
    skills = F.transform(F.array_sort(F.map_entries("skill_groups")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    education = F.transform("education", lambda x: F.concat_ws("", F.lit("- "), x["degree"], F.lit(", "), x["school"]))
    work = F.transform("experience", lambda x: F.concat_ws("", F.lit("- "), x["title"], F.lit(" at "), x["company"], F.lit(" ("), x["start"], F.lit(" to "), x["end"], F.lit(")")))
    languages = F.transform("languages", lambda x: F.concat_ws("", F.lit("- "), x["name"], F.lit(": "), x["level"]))
    return resume.select(*ids, F.concat_ws("\n", head("Skills", skills), head("Education", education), head("Experience", work), head("Languages", languages)).alias("digest"))


def role_keywords(keywords: Column) -> Column:
    """Keywords trimmed, in lower case, once each and in order."""
    return F.array_distinct(F.filter(F.transform(keywords, lambda k: F.lower(F.trim(k))), lambda k: F.length(k) > 0))


def stored_roles(roles: DataFrame, column: str = "value") -> DataFrame:
    """Suggested roles kept as JSON text; text that is none gives no rows."""
    schema = "struct<roles:array<struct<title_de:string,title_en:string,why:string,search_keywords:array<string>,confidence:double>>>"
    r = roles.select(F.explode(F.from_json(column, schema)["roles"]).alias("r")).select("r.*")
    return r.withColumn("search_keywords", role_keywords(F.col("search_keywords")))


def latest_prompts(files: DataFrame) -> DataFrame:
    """(name, version, text) of prompt files (path, text) called ``name.vN.md``: the highest number, v10 above v9."""
    pattern = r"([^/]+)\.v(\d+)\.md$"
    v = files.withColumn("name", F.regexp_extract("path", pattern, 1)).withColumn("n", F.regexp_extract("path", pattern, 2).try_cast("int")).filter("n IS NOT NULL")
    return v.groupBy("name").agg(F.max("n").alias("n"), F.max_by("text", "n").alias("text")).select("name", F.concat(F.lit("v"), F.col("n").cast("string")).alias("version"), "text")


def script_problem(answer: Column) -> Column:
    """What keeps a script answer (JSON) from being used, or null: five lines in both languages, a subject, a body with ``{place}``."""
    a = F.from_json(answer, "struct<script_lines:array<struct<de:string,en:string>>,email_subject:string,email_body:string>")
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    return (
        F.when(a["script_lines"].isNull() | (F.size(a["script_lines"]) != SCRIPT_LINES), f"not {SCRIPT_LINES} lines")
        .when(F.exists(a["script_lines"], lambda x: x.isNull() | blank(x["de"]) | blank(x["en"])), "a line lacks a language")
        .when(blank(a["email_subject"]) | blank(a["email_body"]), "no subject or no body")
        .when(~F.contains(a["email_body"], F.lit("{place}")), "no place for the name")
    )
