"""Runs, sources' health, cursors and the user's marks: state as folds over append-only events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.constants import COOLDOWN_HOURS, FAILURES_BEFORE_COOLDOWN, STALE_RUN_MINUTES, STATUSES

OFFLINE = ["getaddrinfo", "name or service not known", "network is unreachable", "no route to host", "temporary failure in name resolution"]


def status_fold(events: DataFrame) -> DataFrame:
    """(job_id, status, notes, applied_on, updated_at) of mark events (job_id, event_id, ts, status, notes).

    The last status; the last note (status events leave notes alone); the first time of 'applied', never rewritten.
    """
    at = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), at)), F.lit("new")).alias("status"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), at)).alias("notes"),
        F.min(F.when(F.col("status") == "applied", F.col("ts"))).alias("applied_on"),
        F.max("ts").alias("updated_at"),
    )


def run_rollup(outcomes: DataFrame) -> DataFrame:
    """(run_id, source, found, new, duplicate) of arrivals with their outcome."""
    return outcomes.groupBy("run_id", "source").agg(F.count("*").alias("found"), F.count_if(F.col("outcome") == "new").alias("new"), F.count_if(F.col("outcome") == "duplicate").alias("duplicate"))


def page_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("run_id", "source", "query_index", "page").agg(F.count("*").alias("found"), F.count_if(F.col("outcome") == "new").alias("new"))


def merge_legs(legs: DataFrame) -> DataFrame:
    """Counts of a search's legs summed by source."""
    return legs.groupBy("source").agg(F.sum("found").alias("found"), F.sum("new").alias("new"), F.sum("duplicate").alias("duplicate"), F.count_distinct("run_id").alias("legs"))


def latest_run(runs: DataFrame, kind: str | None = None) -> DataFrame:
    rows = runs.filter(F.col("kind") == kind) if kind else runs
    return rows.orderBy(F.col("run_id").desc()).limit(1)


def display_state(state: Column, last_progress: Column, started: Column, now: Column, minutes: int = STALE_RUN_MINUTES) -> Column:
    """A run that says nothing for ten minutes is shown as interrupted."""
    silent = now - F.coalesce(last_progress, started) >= F.make_dt_interval(mins=F.lit(minutes))
    return F.when(state != "running", state).when(F.coalesce(silent, F.lit(True)), "interrupted").otherwise("running")


def close_stale(runs: DataFrame, now: Column, minutes: int = STALE_RUN_MINUTES) -> DataFrame:
    """Runs with the state that the next start of a search leaves: silent ones closed."""
    silent = F.col("last_progress_at").isNull() | (F.col("last_progress_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.withColumn("state", F.when((F.col("state") == "running") & silent, "interrupted").otherwise(F.col("state")))


def source_health(events: DataFrame) -> DataFrame:
    """(source, consecutive_failures, last_error_at, cooldown_until) of run events (source, event_id, ts, failed).

    Failures count since the last success; a third in a row pauses the source for a day from that failure on.
    Aggregated in two passes without a sort: last success by source, then what came after it.
    """
    last_good = events.filter(~F.col("failed")).groupBy("source").agg(F.max(F.struct("ts", "event_id")).alias("good"))
    after = events.filter("failed").join(last_good, "source", "left").filter(F.col("good").isNull() | (F.struct("ts", "event_id") > F.col("good")))
    bad = after.groupBy("source").agg(F.count("*").alias("consecutive_failures"), F.max("ts").alias("last_error_at"))
    return (
        events.select("source").distinct().join(bad, "source", "left")
        .select("source", F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), "last_error_at")
        .withColumn("cooldown_until", F.when(F.col("consecutive_failures") >= FAILURES_BEFORE_COOLDOWN, F.col("last_error_at") + F.make_dt_interval(hours=F.lit(COOLDOWN_HOURS))))
    )


def allowed_sources(health: DataFrame, now: Column) -> DataFrame:
    """Sources that are not paused."""
    return health.filter(F.col("cooldown_until").isNull() | (now >= F.col("cooldown_until")))


def resume_cursor(pages: DataFrame) -> DataFrame:
    """(source, spec_hash, query_index, next_page): where a search goes on, from the pages (source, spec_hash, query_index, page) stored; page 0 is none."""
    at = F.max(F.struct("query_index", "page"))
    return pages.filter("page > 0").groupBy("source", "spec_hash").agg(at.alias("at")).select("source", "spec_hash", "at.query_index", (F.col("at.page") + 1).alias("next_page"))


def run_trouble(runs: DataFrame, run_sources: DataFrame) -> DataFrame:
    """(run_id, all_failed, offline): whether every source of a run failed, and whether its errors read as no network."""
    failed = run_sources.groupBy("run_id").agg(F.bool_and(F.col("state").isin("failed", "skipped")).alias("all_failed"))
    said = F.lower(F.coalesce("errors", F.lit("")))
    offline = reduce(lambda a, b: a | b, [F.contains(said, F.lit(w)) for w in OFFLINE])
    return runs.join(failed, "run_id").select("run_id", "all_failed", (F.col("all_failed") & offline).alias("offline"))


def fresh_requests(requests: DataFrame, cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Requests that no cached answer with status 200, younger than ``hours``, serves."""
    alive = cache.filter((F.col("status") == 200) & (F.col("fetched_at") > now - F.make_dt_interval(hours=F.lit(hours)))).select("cache_key").distinct()
    return requests.join(alive, "cache_key", "left_anti")


def runs_of(events: DataFrame) -> DataFrame:
    """The journal of runs from its events (run_id, event_id, ts, what, found, new, error).

    ``what`` is 'start', 'progress' or 'finish'. A run started again after it finished is running. Counts are summed
    over progress; errors are named once each.
    """
    at = F.struct("ts", "event_id")
    is_ = lambda w: F.col("what") == w
    r = events.groupBy("run_id").agg(
        F.max(F.when(is_("start"), at)).alias("start"), F.max(F.when(is_("finish"), at)).alias("finish"), F.max(F.when(is_("progress"), F.col("ts"))).alias("last_progress_at"),
        F.coalesce(F.sum(F.when(is_("progress"), F.col("found"))), F.lit(0)).alias("found_count"), F.coalesce(F.sum(F.when(is_("progress"), F.col("new"))), F.lit(0)).alias("new_count"),
        F.array_sort(F.collect_set("error")).alias("errors"),
    )
    done = F.coalesce(F.col("finish") > F.col("start"), F.col("start").isNull() & F.col("finish").isNotNull())
    return r.select(
        "run_id", F.when(done, "done").otherwise("running").alias("state"), F.col("start.ts").alias("started_at"), "last_progress_at", F.when(done, F.col("finish.ts")).alias("finished_at"), "found_count", "new_count", "errors",
    )


def resumable_run(runs: DataFrame, with_pages: DataFrame, newest: int = 20) -> DataFrame:
    """Of the newest searches the latest that was interrupted and has pages (run_id) to go on from; none or one row."""
    recent = runs.filter("kind = 'search'").orderBy(F.col("run_id").desc()).limit(newest)
    return recent.filter("state = 'interrupted'").join(with_pages, "run_id", "left_semi").orderBy(F.col("run_id").desc()).limit(1)


def refused_marks(marks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Mark events that are not taken, with the reason: no known status, or no known job."""
    known = jobs.select("job_id", F.lit(True).alias("known"))
    bad = F.when(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "unknown status").when(F.col("known").isNull(), "unknown job")
    return marks.join(known, "job_id", "left").withColumn("reason", bad).filter("reason IS NOT NULL").drop("known")
