"""The queries of the operators in this subpackage, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import bpe, cities, employers, mixing, pages, sentences, truncation
from stellwerk.llm.samples import fitted
from stellwerk.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def _employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The reference list of towns has a fixed number of entries.
    places = [r[0] for r in table(spark, sf_dir, "ref_cities").select("name").collect()]
    return employers.link_employers(table(spark, sf_dir, "jobs").select("company"), places)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employers.employer_pairs(_employers(spark, sf_dir))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _employers(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    jobs = table(spark, sf_dir, "jobs").select(F.lit("jobs").alias("origin"), F.col("job_id").alias("row_key"), "city", "plz")
    raw = table(spark, sf_dir, "raw_postings").select(F.lit("raw_postings").alias("origin"), F.col("posting_no").cast("string").alias("row_key"), "city", "plz")
    return cities.map_cities(jobs.unionByName(raw), table(spark, sf_dir, "ref_cities"))


#: Page models by application and tables: the three queries on pages share one fit.
_MODELS: dict[tuple[str, str], object] = {}


def _page_model(spark: SparkSession, sf_dir: str) -> object:
    """The classifier of the corpus below ``sf_dir``, fitted once in a session."""
    ship(spark)
    corpus = (spark.sparkContext.applicationId, sf_dir)
    if corpus not in _MODELS:
        _MODELS[corpus] = _fit_page_model(spark, sf_dir)
    return _MODELS[corpus]


def _fit_page_model(spark: SparkSession, sf_dir: str) -> object:
    descriptions, raw, jobs = table(spark, sf_dir, "job_descriptions"), table(spark, sf_dir, "raw_postings"), table(spark, sf_dir, "jobs")
    sample = pages.sample_pages(descriptions.select("job_id", "description"), raw.select("job_id", "description"), jobs.select("job_id", "title"))
    return fitted(sample, pages.fit_pages)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.body_lines(table(spark, sf_dir, "job_descriptions"), _page_model(spark, sf_dir), of_ad=False)


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.bodies(table(spark, sf_dir, "job_descriptions"), _page_model(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.residue(table(spark, sf_dir, "job_descriptions"), _page_model(spark, sf_dir))


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descriptions; the source of a stored one is what its job_id begins with (``source:source_id``)."""
    raw = table(spark, sf_dir, "raw_postings").select(F.lit("raw_postings").alias("origin"), "source", F.col("posting_no").cast("string").alias("row_key"), F.col("description").alias("text"))
    stored = table(spark, sf_dir, "job_descriptions").select(F.lit("job_descriptions").alias("origin"), F.substring_index("job_id", ":", 1).alias("source"), F.col("job_id").alias("row_key"), F.col("description").alias("text"))
    return stored.unionByName(raw).filter("text IS NOT NULL")


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    texts = _descriptions(spark, sf_dir)
    known = truncation.known_words(texts)
    # The words, which are many, go to the task, but need not come back.
    ends = fitted(truncation.sample_texts(texts), lambda rows: replace(truncation.fit_ends([r[0] for r in rows], known), known=()))
    ends = replace(ends, known=known)
    return truncation.find_cut(texts, ends, truncation.baselines(texts))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).filter("cut").select("origin", "row_key")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_shares(_cuts(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_column(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_members, p3_found, p3_bodies, p4_found, p5_found, p7_found, p7_shares, p8_ids, p9_mix, p9_shares, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {}
