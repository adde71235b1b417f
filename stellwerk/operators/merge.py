"""Postings from many sources merged into one row per ad.

The rule, per arrival in order: an id that is known only moves ``last_seen``; an ad whose identity is known from
*another* source attaches to the earliest row of that identity; all else is a new row. As a set: an identity belongs
to the source that reported it first (its owner). Arrivals of the owner are rows under their own id, all others attach
to the first row. Everything is grouped aggregation with partial sums on the map side (``min_by``, ``max``), so an
identity or id with a third of all arrivals costs its tasks no more than others; nothing is sorted within a group.

Arrivals are read twice: :func:`placed` reduces them to a narrow row per
id, which is materialised; what wins is decided on sequence numbers; texts are fetched last, by the winning number.

An id keeps the identity of its first arrival. Arrivals are totally ordered by ``seq``, which is unique.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.functions.text import content_hash, dedupe_key, non_blank
from stellwerk.session import cut


def placed(arrivals: DataFrame, seq: str = "seq", more: Mapping[str, Column] | None = None) -> DataFrame:
    """(job_id, key, source, first_seq, row_id): a row per id with its identity and the row that it belongs to.

    ``more`` are further aggregates of an id's arrivals, by name.
    """
    key = dedupe_key(F.col("title"), F.col("company"), F.col("city"))
    ids = cut(
        arrivals.withColumn("key", key).groupBy("job_id")
        .agg(F.min_by("key", seq).alias("key"), F.min_by("source", seq).alias("source"), F.min(seq).alias("first_seq"), *[c.alias(n) for n, c in (more or {}).items()])
    )
    owners = ids.groupBy("key").agg(F.min_by("source", "first_seq").alias("owner"), F.min_by("job_id", "first_seq").alias("target"))
    row_id = F.when(F.col("source") == F.col("owner"), F.col("job_id")).otherwise(F.col("target"))
    return ids.join(owners, "key").select("job_id", "key", "source", "first_seq", row_id.alias("row_id"), *(more or {}))


def merge(arrivals: DataFrame, seq: str = "seq") -> DataFrame:
    """The stored jobs: one row per merged ad."""
    own = F.col("job_id") == F.col("row_id")
    # Of each id: its last arrival, and for what fills a gap, its first with a text and its first with an address.
    has_url = F.coalesce(F.col("apply_url") != "", F.lit(False))
    seen = {"last_seq": F.max(seq), "text_seq": F.min(F.when(non_blank(F.col("description")), F.col(seq))), "url_seq": F.min(F.when(has_url, F.col(seq)))}
    of_id = cut(placed(arrivals, seq, seen))
    rows = of_id.groupBy("row_id").agg(
        F.any_value("key").alias("dedupe_key"), F.min(F.when(own, F.col("first_seq"))).alias("first_seq"), F.max("last_seq").alias("last_seq"),
        F.min(F.when(~own, F.col("text_seq"))).alias("text_seq"), F.min(F.when(~own, F.col("url_seq"))).alias("url_seq"),
    )
    # A source is the first of its ids' in a row; there are as many as sources, whatever the number of arrivals.
    others = (
        of_id.filter(~own).groupBy("row_id", "source").agg(F.min("first_seq").alias("s"))
        .groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "source"))), lambda x: x["source"]), ",").alias("also_seen_on"))
    )
    wins = rows.join(others, "row_id", "left")
    texts = arrivals.select(F.col(seq).alias("at"), "source", "title", "company", "city", "description", "apply_url")
    # The winning arrivals of a row, two at most beside its own, are fetched by number and gathered again.
    parts = wins.select("row_id", F.explode(F.array_distinct(F.array_compact(F.array("first_seq", "text_seq", "url_seq")))).alias("at")).join(texts, "at")
    first = lambda c: F.max(F.when(F.col("at") == F.col("first_seq"), F.col(c)))
    got = (
        parts.join(rows.select("row_id", "first_seq", "text_seq", "url_seq"), "row_id")
        .groupBy("row_id")
        .agg(
            *[first(c).alias(c) for c in ("source", "title", "company", "city")], first("description").alias("own_text"), first("apply_url").alias("own_url"),
            F.max(F.when(F.col("at") == F.col("text_seq"), F.col("description"))).alias("other_text"), F.max(F.when(F.col("at") == F.col("url_seq"), F.col("apply_url"))).alias("other_url"),
        )
    )
    text = F.when(non_blank(F.col("own_text")), F.col("own_text")).otherwise(F.coalesce("other_text", "own_text"))
    return (
        wins.join(got, "row_id")
        .withColumn("description", text)
        .select(
            F.col("row_id").alias("job_id"), "source", "dedupe_key", "title", "company", "city", "description", content_hash(F.col("description")).alias("content_hash"),
            F.when(F.col("own_url") != "", F.col("own_url")).otherwise(F.coalesce("other_url", "own_url")).alias("apply_url"), "also_seen_on", "first_seq", "last_seq",
        )
    )


def also_seen_on(arrivals: DataFrame, seq: str = "seq") -> DataFrame:
    """(job_id, also_seen_on): the other sources of each merged ad, in the order in which they reported it."""
    ids = placed(arrivals, seq).filter("job_id != row_id")
    firsts = ids.groupBy("row_id", "source").agg(F.min("first_seq").alias("s"))
    return firsts.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "source"))), lambda x: x["source"]), ",").alias("also_seen_on")).withColumnRenamed("row_id", "job_id")


def outcomes(arrivals: DataFrame, seq: str = "seq", carry: Sequence[str] = ()) -> DataFrame:
    """(seq, job_id, row_id, outcome, and the columns to carry): 'new' for the arrival that made a row, else 'duplicate'."""
    made = F.when((F.col("job_id") == F.col("row_id")) & (F.col(seq) == F.col("first_seq")), "new").otherwise("duplicate")
    ids = placed(arrivals, seq).select("job_id", "row_id", "first_seq")
    return arrivals.select(seq, "job_id", *carry).join(ids, "job_id").select(seq, "job_id", "row_id", made.alias("outcome"), *carry)


FIRST = ["key", "source", "title", "company", "city", "description", "apply_url"]


def summaries(arrivals: DataFrame, seq: str = "seq") -> DataFrame:
    """A row per id that the rule needs no arrival beside: its first arrival, and its first text and address with their numbers.

    Summaries of parts of the arrivals make those of all by :func:`combined`.
    """
    has_url = F.coalesce(F.col("apply_url") != "", F.lit(False))
    text_at, url_at = F.when(non_blank(F.col("description")), F.col(seq)), F.when(has_url, F.col(seq))
    keys = arrivals.withColumn("key", dedupe_key(F.col("title"), F.col("company"), F.col("city")))
    return keys.groupBy("job_id").agg(
        *[F.min_by(c, seq).alias(c) for c in FIRST], F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
        F.min_by("description", text_at).alias("text"), F.min(text_at).alias("text_seq"), F.min_by("apply_url", url_at).alias("url"), F.min(url_at).alias("url_seq"),
    )


def combined(parts: DataFrame) -> DataFrame:
    """One summary per id of several."""
    return parts.groupBy("job_id").agg(
        *[F.min_by(c, "first_seq").alias(c) for c in FIRST], F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        F.min_by("text", "text_seq").alias("text"), F.min("text_seq").alias("text_seq"), F.min_by("url", "url_seq").alias("url"), F.min("url_seq").alias("url_seq"),
    )


def merged(ids: DataFrame) -> DataFrame:
    """The stored jobs, as :func:`merge` has them, of summaries that are whole for each of their identities."""
    owners = ids.groupBy("key").agg(F.min_by("source", "first_seq").alias("owner"), F.min_by("job_id", "first_seq").alias("target"))
    rows = ids.join(owners, "key").withColumn("row_id", F.when(F.col("source") == F.col("owner"), F.col("job_id")).otherwise(F.col("target")))
    own = F.col("job_id") == F.col("row_id")
    mine = lambda c: F.max(F.when(own, F.col(c)))
    others = (
        rows.filter(~own).groupBy("row_id", "source").agg(F.min("first_seq").alias("s"))
        .groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "source"))), lambda x: x["source"]), ",").alias("also_seen_on"))
    )
    got = rows.groupBy("row_id").agg(
        F.any_value("key").alias("dedupe_key"), *[mine(c).alias(c) for c in ("source", "title", "company", "city", "first_seq")], mine("description").alias("own_text"), mine("apply_url").alias("own_url"),
        F.min_by("text", F.when(~own, F.col("text_seq"))).alias("other_text"), F.min_by("url", F.when(~own, F.col("url_seq"))).alias("other_url"), F.max("last_seq").alias("last_seq"),
    )
    text = F.when(non_blank(F.col("own_text")), F.col("own_text")).otherwise(F.coalesce("other_text", "own_text"))
    return (
        got.join(others, "row_id", "left").withColumn("description", text)
        .select(
            F.col("row_id").alias("job_id"), "source", "dedupe_key", "title", "company", "city", "description", content_hash(F.col("description")).alias("content_hash"),
            F.when(F.col("own_url") != "", F.col("own_url")).otherwise(F.coalesce("other_url", "own_url")).alias("apply_url"), "also_seen_on", "first_seq", "last_seq",
        )
    )
