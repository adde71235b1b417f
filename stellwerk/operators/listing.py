"""The filtered, sorted and paged list of jobs, its total, its facets and the page of one job.

A request is a validated :class:`JobFilters`; :func:`listing` turns it into one lazy plan over three tables. Filters on
jobs reach the scan, the status and answer tables are joined on their key after their own filters, and a page is a
top-k (``TakeOrderedAndProject``), whatever the sort. What filters compare is stored as columns when jobs and answers are
(:func:`store`): the day of publication, by which the rows are clustered, and the answers' fields; no request parses
dates or JSON.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.constants import LEVELS, PAGE_SIZE, POSTED_WITHIN, SORTS, STALE_DAYS, STATUSES, TYPE_FLAGS, TYPE_LABELS
from stellwerk.functions.dates import published_on
from stellwerk.functions.geo import km_from_home
from stellwerk.functions.text import level_rank

LIST_COLUMNS = "job_id title company city plz lat lon source employment_type_raw is_minijob is_werkstudent is_parttime is_fulltime is_internship homeoffice published_at apply_url source_url also_seen_on first_seen_at last_seen_at".split()


@dataclass(frozen=True)
class JobFilters:
    """A validated request; empty tuples and None mean no bound."""

    statuses: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    max_german: str | None = None
    min_fit: int | None = None
    posted_within: int | None = None
    sort: str = "fit"
    page: int = 1


def parse_filters(query: Mapping[str, str | Iterable[str]]) -> JobFilters:
    """Request parameters to filters: repeated values once and in order, what is unknown or out of range dropped."""

    def values(name: str, allowed: Iterable[str] | None = None) -> tuple[str, ...]:
        got = query.get(name) or ()
        got = [got] if isinstance(got, str) else got
        return tuple(dict.fromkeys(v for v in got if v and (allowed is None or v in allowed)))

    def number(name: str) -> int | None:
        got = values(name)
        return int(got[0]) if got and got[0].lstrip("-").isdigit() else None

    fit, within, page = number("min_fit"), number("posted_within"), number("page")
    level, sort = values("max_german", LEVELS), values("sort", SORTS)
    return JobFilters(
        values("status", STATUSES), values("city"), values("source"), values("type", TYPE_FLAGS), level[0] if level else None, fit if fit is not None and 0 <= fit <= 100 else None,
        within if within in POSTED_WITHIN else None, sort[0] if sort else "fit", max(1, page or 1),
    )


def describe(filters: JobFilters) -> str:
    """The filters in words."""
    either = lambda v: v[0] if len(v) == 1 else ", ".join(v[:-1]) + " or " + v[-1]
    parts = [either(v) for v in (filters.types, filters.cities, filters.sources, filters.statuses) if v]
    parts += [f"German up to {filters.max_german}"] if filters.max_german else []
    parts += [f"fit {filters.min_fit} or more"] if filters.min_fit is not None else []
    parts += [f"posted in the last {filters.posted_within} days"] if filters.posted_within else []
    return "; ".join(parts)


def answers_at(enrichment: DataFrame, version: str) -> DataFrame:
    """(job_id, german_level, german_rank, fit_score, summary_en) of the answers at one prompt version; broken JSON gives nulls."""
    field = lambda name: F.get_json_object("answer", f"$.{name}")
    return enrichment.filter(F.col("prompt_version") == version).select(
        "job_id", field("german_level").alias("german_level"), level_rank(field("german_level")).alias("german_rank"), field("fit_score").try_cast("double").alias("fit_score"), field("summary_en").alias("summary_en")
    )


def store(jobs: DataFrame, enrichment: DataFrame, version: str, folder: str) -> str:
    """Write jobs with ``published_on``, clustered by it, and the answers at a version as columns; returns the folder."""
    dated = jobs.withColumn("published_on", published_on(F.col("published_at")))
    dated.repartitionByRange("published_on", "job_id").sortWithinPartitions("published_on").write.mode("overwrite").parquet(f"{folder}/jobs")
    answers_at(enrichment, version).write.mode("overwrite").parquet(f"{folder}/answers")
    return folder


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stored jobs and answers."""
    return spark.read.parquet(f"{folder}/jobs"), spark.read.parquet(f"{folder}/answers")


def type_label() -> Column:
    """Flags in fixed order joined by ' / ', else the raw text, else ''."""
    label = F.concat_ws(" / ", *[F.when(F.col(c), F.lit(text)) for c, text in TYPE_LABELS.items()])
    return F.when(label != "", label).otherwise(F.coalesce("employment_type_raw", F.lit("")))


def german_tier(level: Column, own: str = "A2") -> Column:
    """comfortable, stretch (one above one's own), out, or unknown."""
    mine = LEVELS.index(own if own in LEVELS else "A2")
    rank = level_rank(level)
    return F.when(rank < 0, "unknown").when((rank == 0) | (rank <= mine), "comfortable").when(rank == mine + 1, "stretch").otherwise("out")


def stale(now: Column, days: int = STALE_DAYS) -> Column:
    """Not seen for so many days, or never."""
    return F.coalesce(F.col("last_seen_at") < now - F.make_dt_interval(F.lit(days)), F.lit(True))


def matching(jobs: DataFrame, status: DataFrame, answers: DataFrame, filters: JobFilters, now: Column) -> DataFrame:
    """The jobs that fit the filters, with status and answer; a missing status is 'new'."""
    if filters.cities:
        jobs = jobs.filter(F.col("city").isin(*filters.cities))
    if filters.sources:
        jobs = jobs.filter(F.col("source").isin(*filters.sources))
    if filters.types:
        jobs = jobs.filter(reduce(lambda a, b: a | b, [F.col(TYPE_FLAGS[t]) for t in filters.types]))
    if filters.posted_within is not None:
        jobs = jobs.filter(F.col("published_on") >= F.date_sub(now.cast("date"), filters.posted_within))
    if filters.max_german is not None:
        answers = answers.filter(F.col("german_rank").between(0, LEVELS.index(filters.max_german)))
    if filters.min_fit is not None:
        answers = answers.filter(F.col("fit_score") >= filters.min_fit)
    how = "inner" if filters.max_german is not None or filters.min_fit is not None else "left"
    joined = jobs.join(answers, "job_id", how).join(status.select("job_id", "status"), "job_id", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    return joined.filter(F.col("status").isin(*filters.statuses) if filters.statuses else F.col("status") != "deleted")


def order_of(sort: str) -> list[Column]:
    """The sort's columns; the id last, so that pages never overlap."""
    if sort == "fit":
        return [F.col("fit_score").desc_nulls_last(), F.col("last_seen_at").desc_nulls_last(), F.col("job_id")]
    if sort == "date":
        return [F.col("published_at").desc_nulls_last(), F.col("first_seen_at").desc_nulls_last(), F.col("job_id")]
    return [F.col("distance_km").asc_nulls_last(), F.col("job_id")]


def listing(jobs: DataFrame, status: DataFrame, answers: DataFrame, filters: JobFilters, now: Column, own_level: str = "A2") -> DataFrame:
    """One page of the list."""
    rows = matching(jobs, status, answers, filters, now).withColumn("distance_km", km_from_home(F.col("lat"), F.col("lon")))
    page = rows.orderBy(*order_of(filters.sort)).offset((filters.page - 1) * PAGE_SIZE).limit(PAGE_SIZE)
    return page.select(
        *LIST_COLUMNS, "status", "german_level", "fit_score", "summary_en", "distance_km",
        german_tier(F.col("german_level"), own_level).alias("tier"), stale(now).alias("stale"), type_label().alias("type_label"),
    )


def total(jobs: DataFrame, status: DataFrame, answers: DataFrame, filters: JobFilters, now: Column) -> DataFrame:
    """How many jobs fit the filters."""
    return matching(jobs, status, answers, filters, now).agg(F.count("*").alias("total"))


def pages(total_rows: int, size: int = PAGE_SIZE) -> int:
    return max(1, math.ceil(total_rows / size))


def page_count(rows: Column, size: int = PAGE_SIZE) -> Column:
    """How many pages so many rows fill; at least one."""
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")


def facet(jobs: DataFrame, column: str) -> DataFrame:
    """The distinct non-null values of a column, in order."""
    return jobs.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def job_page(jobs: DataFrame, status: DataFrame, descriptions: DataFrame, enrichment: DataFrame, job_id: str, version: str, now: Column) -> DataFrame:
    """All that is known of one job: a point lookup through four tables. An answer that is no JSON object is none."""
    one = F.col("job_id") == job_id
    answer = enrichment.filter(one & (F.col("prompt_version") == version)).select("job_id", F.when(F.rlike("answer", F.lit(r"^\s*\{")) & F.get_json_object("answer", "$").isNotNull(), F.col("answer")).alias("answer"))
    return (
        jobs.filter(one)
        .join(status.filter(one).select("job_id", "status", "notes"), "job_id", "left")
        .join(descriptions.filter(one).select("job_id", "description"), "job_id", "left")
        .join(answer, "job_id", "left")
        .select(*LIST_COLUMNS, F.coalesce("status", F.lit("new")).alias("status"), "notes", "description", "answer", stale(now).alias("stale"), type_label().alias("type_label"))
    )
