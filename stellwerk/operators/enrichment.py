"""Versioned model answers: what needs one, what is cached, whether an answer holds, and its row for export.

The model itself is an injected function; anything around it is a plan. Answers are JSON text; their rules are checked
by expressions over the parsed document, so that a wrong type is told from a missing field.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.constants import ANSWER_LISTS, ENGLISH_FIELDS, ENRICHED_CSV, LEVELS, TYPE_FLAGS, TYPE_LABELS
from stellwerk.functions.text import casefold, content_hash, fingerprint, reads_as_german, squeeze
from stellwerk.schemas import ANSWER
from stellwerk.session import cut


def needing_answer(jobs: DataFrame, descriptions: DataFrame, enrichment: DataFrame, version: str) -> DataFrame:
    """Jobs with a text that has no answer at this version, or one to another text; in the queue's order unsorted."""
    texts = descriptions.filter(F.length(F.trim("description")) > 0).select("job_id", "description", content_hash(F.col("description")).alias("text_hash"))
    done = enrichment.filter(F.col("prompt_version") == version).select("job_id", F.col("content_hash").alias("done_hash"), F.lit(True).alias("done"))
    joined = jobs.join(texts, "job_id").join(done, "job_id", "left")
    return joined.filter(F.col("done").isNull() | ~F.col("done_hash").eqNullSafe(F.col("text_hash"))).drop("done", "done_hash")


def queue(pending: DataFrame, limit: int | None = None, skip: DataFrame | None = None) -> DataFrame:
    """The oldest jobs first; ``skip`` (job_id) are left out."""
    rows = pending if skip is None else pending.join(skip, "job_id", "left_anti")
    rows = rows.orderBy("first_seen_at", "job_id")
    return rows if limit is None else rows.limit(limit)


def latest_answers(answers: DataFrame) -> DataFrame:
    """One answer per job and version, the last saved; other versions stay."""
    return answers.groupBy("job_id", "prompt_version").agg(F.max_by(F.struct("answer", "enriched_at", "content_hash", "provider_used"), F.struct("enriched_at", "answer")).alias("a")).select("job_id", "prompt_version", "a.*")


def prompts(work: DataFrame, template: str, digest: str) -> DataFrame:
    """(job_id, prompt): template, facts that the source gave, the ad, the applicant's digest."""
    stated = lambda name, c: F.concat(F.lit(name + ": "), F.when(F.length(c) > 0, F.col(c)).otherwise("not stated"))
    flags = F.concat_ws(", ", *[F.when(F.col(c), F.lit(text)) for c, text in TYPE_LABELS.items()])
    facts = F.concat_ws(
        "\n", stated("Title", "title"), stated("Company", "company"), stated("City", "city"),
        F.when(F.length("employment_type_raw") > 0, F.concat(F.lit("Employment type as given: "), F.col("employment_type_raw"))),
        F.when(flags != "", F.concat(F.lit("Flags: "), flags)), F.when(F.col("homeoffice"), F.lit("Home office possible.")),
        F.when(F.length("apply_url") > 0, F.concat(F.lit("Apply at: "), F.col("apply_url"))),
    )
    return work.select("job_id", F.concat_ws("\n\n---\n\n", F.lit(template), facts, F.trim("description"), F.lit(digest)).alias("prompt"))


def cache_key(version: str, prompt: Column, spec: str) -> Column:
    return fingerprint(F.lit(version), F.sha1(prompt), F.lit(spec))


def with_cached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions (key, ...) with the answer that the cache has; null is a miss."""
    return asked.join(cache.select("key", F.col("answer").alias("cached_answer")), "key", "left")


class QuotaSpent(Exception):
    """What a model answers when it will answer no more."""


def ask(misses: DataFrame, model: Callable[[list[str]], list[dict | Exception]], batch: int = 16) -> DataFrame:
    """(job_id, answer, problem) of questions (job_id, prompt): the model sees small batches, a failure is a row.

    A batch that fails as a whole is a row of failure each. After :class:`QuotaSpent` a task asks no more: what is left
    has the problem "quota spent", and is pending again in the next run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = False
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                try:
                    got = [QuotaSpent()] * part.num_rows if spent else model(part.column(1).to_pylist())
                except Exception as e:  # noqa: BLE001
                    got = [e] * part.num_rows
                spent = spent or any(isinstance(g, QuotaSpent) for g in got)
                good = [None if isinstance(g, Exception) else json.dumps(g, ensure_ascii=False, sort_keys=True) for g in got]
                bad = [("quota spent" if isinstance(g, QuotaSpent) else str(g)) if isinstance(g, Exception) else None for g in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(good, pa.string()), pa.array(bad, pa.string())], names=["job_id", "answer", "problem"])

    return misses.select("job_id", "prompt").mapInArrow(run, "job_id string, answer string, problem string")


def enrich(
    jobs: DataFrame, descriptions: DataFrame, enrichment: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[dict | Exception]],
    *, version: str, template: str, digest: str, spec: str, provider: str, limit: int | None = None, skip: DataFrame | None = None,
) -> DataFrame:
    """One run: (job_id, key, text_hash, answer, problem, cached, unevidenced, provider_used) of the jobs that it took.

    The queue of what needs an answer, its prompts, the cache, the model for what the cache lacks (each question once,
    however many jobs ask it), the rules on answers, cached ones too, and the check of evidence against the ad: a level
    without it becomes 'unclear' and is counted. An answer with a problem is not kept; :func:`kept` and
    :func:`cache_puts` are what a run saves, :func:`failed` what the next one may skip. The answers are materialised,
    so that no reading of the result asks the model again.
    """
    work = queue(needing_answer(jobs, descriptions, enrichment, version), limit, skip)
    asked = prompts(work, template, digest).withColumn("key", cache_key(version, F.col("prompt"), spec))
    asked = cut(asked.join(work.select("job_id", "text_hash", "description"), "job_id"))
    found = with_cached(asked.select("key").distinct(), cache)
    misses = found.filter("cached_answer IS NULL").join(asked.groupBy("key").agg(F.any_value("prompt").alias("prompt")), "key").select(F.col("key").alias("job_id"), "prompt")
    said = cut(ask(misses, model)).select(F.col("job_id").alias("key"), "answer", F.col("problem").alias("fault"))
    told = asked.join(found, "key", "left").join(said, "key", "left").withColumn("cached", F.col("cached_answer").isNotNull()).withColumn("raw", F.coalesce("cached_answer", "answer"))
    judged = told.withColumn("problem", F.coalesce("fault", answer_problem(F.col("raw")))).withColumn("a", F.from_json("raw", ANSWER))
    level, evidence = grounded(F.col("a.german_level"), F.col("a.german_evidence"), F.col("description"))
    sound = F.col("problem").isNull()
    return judged.select(
        "job_id", "key", "text_hash", F.when(sound, F.to_json(F.col("a").withField("german_level", level).withField("german_evidence", evidence))).alias("answer"), "problem", "cached",
        (sound & ~evidence_holds(F.col("a.german_level"), F.col("a.german_evidence"), F.col("description"))).alias("unevidenced"), F.when(sound & ~F.col("cached"), provider).alias("provider_used"),
    )


def kept(run: DataFrame, version: str, now: Column) -> DataFrame:
    """The rows of answers that a run adds (see :func:`latest_answers`)."""
    return run.filter("problem IS NULL").select("job_id", F.lit(version).alias("prompt_version"), "answer", now.alias("enriched_at"), F.col("text_hash").alias("content_hash"), "provider_used")


def cache_puts(run: DataFrame) -> DataFrame:
    """(key, answer) that a run adds to the cache: sound answers that the model gave."""
    return run.filter("problem IS NULL AND NOT cached").groupBy("key").agg(F.min("answer").alias("answer"))


def cache_after(cache: DataFrame, puts: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The cache with what was put, a new answer in place of an old one, without the keys that were deleted."""
    rows = cache.select("key", "answer").join(puts.select("key"), "key", "left_anti").unionByName(puts.select("key", "answer"))
    return rows if deleted is None else rows.join(deleted.select("key"), "key", "left_anti")


def failed(run: DataFrame) -> DataFrame:
    """(job_id) that a further pass of the same run skips: jobs whose answer failed; a spent quota is no failure."""
    return run.filter("problem IS NOT NULL AND problem != 'quota spent'").select("job_id")


def run_counts(run: DataFrame) -> DataFrame:
    """How many answers a run kept, how many failed, what it did not come to, and how many levels lacked evidence."""
    spent = F.coalesce(F.col("problem") == "quota spent", F.lit(False))
    return run.agg(F.count_if(F.col("problem").isNull()).alias("enriched"), F.count_if(F.col("problem").isNotNull() & ~spent).alias("failed"), F.count_if(spent).alias("remaining"), F.count_if("unevidenced").alias("unevidenced"))


def evidence_holds(level: Column, evidence: Column, text: Column) -> Column:
    """Whether the quoted evidence for a level stands in the ad; 'unclear' needs none."""
    flat = lambda c: casefold(squeeze(F.coalesce(c, F.lit(""))))
    return F.coalesce((level == "unclear") | ((F.length(flat(evidence)) > 0) & F.contains(flat(text), flat(evidence))), F.lit(False))


def grounded(level: Column, evidence: Column, text: Column) -> tuple[Column, Column]:
    """Level and evidence, or 'unclear' and '' where the ad does not support them."""
    holds = evidence_holds(level, evidence, text)
    return F.when(holds, level).otherwise("unclear"), F.when(holds, evidence).otherwise("")


def answer_problem(answer: Column) -> Column:
    """The first rule that an answer breaks, in words, or null.

    Rules on type come from the shape of the parsed document (``schema_of_variant``): a number in quotes is no number,
    a boolean is none either; fields that nothing is known of are tolerated.
    """
    doc = F.try_parse_json(answer)
    shape = F.schema_of_variant(doc)
    value = lambda n: F.try_variant_get(doc, f"$.{n}", "string")
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{n}", "variant")), F.lit("VOID"))
    number = lambda n: F.rlike(kind(n), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"))
    missing = lambda n: kind(n) == "VOID"
    checks: list[tuple[Column, str]] = [(doc.isNull(), "not JSON"), (~F.startswith(shape, F.lit("OBJECT")), "not an object")]
    levels, kinds = [*LEVELS, "unclear"], [*TYPE_FLAGS, "unclear"]
    for n in ("category", "seniority", "summary_en", "application_method"):
        checks += [(missing(n), f"{n} is missing"), (kind(n) != "STRING", f"{n} is not text"), (F.length(F.trim(value(n))) == 0, f"{n} is empty")]
    for n, allowed in (("german_level", levels), ("employment_type_norm", kinds)):
        checks += [(missing(n), f"{n} is missing"), (kind(n) != "STRING", f"{n} is not text"), (~value(n).isin(*allowed), f"{n} is not one of the allowed values")]
    checks += [(missing("german_evidence"), "german_evidence is missing"), (kind("german_evidence") != "STRING", "german_evidence is not text")]
    checks += [(missing("english_sufficient"), "english_sufficient is missing"), (kind("english_sufficient") != "BOOLEAN", "english_sufficient is not true or false")]
    for n in ANSWER_LISTS:
        checks += [(missing(n), f"{n} is missing"), (~F.startswith(kind(n), F.lit("ARRAY")), f"{n} is not a list")]
    amount = F.try_variant_get(doc, "$.fit_score", "double")
    hours = F.try_variant_get(doc, "$.hours_per_week", "double")
    checks += [(missing("fit_score"), "fit_score is missing"), (~number("fit_score"), "fit_score is not a number"), (~amount.between(0, 100), "fit_score is out of range")]
    checks += [(~missing("hours_per_week") & ~number("hours_per_week"), "hours_per_week is not a number"), (~hours.between(0, 80), "hours_per_week is out of range")]
    checks += [((value("german_level") != "unclear") & (F.length(F.trim(value("german_evidence"))) == 0), "german_level without evidence")]
    for n in ENGLISH_FIELDS:
        lines = F.try_variant_get(doc, f"$.{n}", "array<string>") if n in ANSWER_LISTS else F.array(value(n))
        checks.append((F.exists(F.coalesce(lines, F.array().cast("array<string>")), lambda x: reads_as_german(x)), f"{n} is in German"))
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks])


def enriched_rows(enrichment: DataFrame, version: str) -> DataFrame:
    """Export rows of the answers at a version: lists joined by '|', booleans as words, null as ''."""
    parsed = enrichment.filter((F.col("prompt_version") == version) & F.rlike("answer", F.lit(r"^\s*\{")) & F.get_json_object("answer", "$").isNotNull()).withColumn("a", F.from_json("answer", ANSWER))
    cell: dict[str, Column] = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("job_id", "enriched_at", "prompt_version", "provider_used")}
    for n in ENRICHED_CSV[4:]:
        c = F.col(f"a.{n}")
        if n in ANSWER_LISTS:
            cell[n] = F.coalesce(F.array_join(F.transform(c, lambda x: F.trim(F.replace(x, F.lit("|"), F.lit("/")))), "|"), F.lit(""))
        elif n in ("fit_score", "hours_per_week"):
            cell[n] = c
        else:
            cell[n] = F.coalesce(c.cast("string"), F.lit(""))
    return parsed.select(*[cell[n].alias(n) for n in ENRICHED_CSV])


def pending_count(pending: DataFrame) -> DataFrame:
    return pending.agg(F.count("*").alias("pending"))


def answered_count(enrichment: DataFrame, version: str) -> DataFrame:
    return enrichment.filter(F.col("prompt_version") == version).agg(F.count("*").alias("answered"))


