"""Mixing sources to target shares of the total size by systematic sampling.

With ``T`` tokens in a source of share ``w``, a mix of ``M`` tokens takes each of its documents ``w * M / T`` times on
average. ``M`` is the largest size at which no source exceeds its cap of repeats, unless a size is given. Within each
source the documents stand in a line (by blocks of hashed ids, within a block by size, which spreads large and small
ones evenly); their expected copies are summed up along the line, one random offset per source is added, and a
document is emitted once for each whole number that its stretch of the line crosses.

The line is never in one task: blocks have a bounded expected number of rows however large a source is, and only
their counts are summed across blocks.

Defined results: null and empty texts have no tokens and are in no mix; documents of sources without target, or with
a null source, are left out, targets without documents get nothing and are reported with share 0 (and do not bound
the size); a target share of 0, null or below takes nothing. Repeated rows are documents of their own. With caps
and a given size that cannot be met, the source gives what its cap allows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.llm.bpe import n_tokens
from stellwerk.session import cut

#: Rows of a source that one block of its line has on average.
BLOCK = 20_000


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have tokens: those whose text is not empty."""
    return documents.filter(F.length("text") > 0).select("doc_id", "source", n_tokens(F.col("text"), path).alias("n_tokens"))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, source_tokens, copies): expected copies of each document."""
    totals = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    known = targets.select("source", F.coalesce(F.greatest("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).join(totals, "source", "left")
    limit = F.when((F.col("target_share") > 0) & (F.col("source_tokens") > 0), F.col("max_repeats") * F.col("source_tokens") / F.col("target_share"))
    size = F.lit(float(total)) if total is not None else F.min(limit).over(Window.partitionBy(F.lit(1)))
    return known.withColumn("total", size).withColumn(
        "copies", F.coalesce(F.least(F.col("target_share") * F.col("total") / F.col("source_tokens"), F.col("max_repeats").cast("double")), F.lit(0.0))
    )


def mix(documents: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 7, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, copy_no, source, n_tokens): the mix, each copy a row; at most ``max_repeats`` copies of a document."""
    sizes = cut(sized(documents, path))
    plans = plan(sizes, targets, total).filter("copies > 0").select("source", "copies", "max_repeats", "n_docs")
    mark = F.xxhash64(F.lit(seed), "doc_id")
    # The plan has a row per target source, a list given by hand; the join is a broadcast only if Spark finds it small.
    placed = sizes.join(plans, "source").withColumn("block", F.pmod(mark, F.ceil(F.col("n_docs") / block).cast("bigint")))
    counts = placed.groupBy("source", "block").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("source", "block", F.coalesce("before", F.lit(0)).alias("before"))
    line = Window.partitionBy("source", "block").orderBy("n_tokens", mark, "doc_id")
    position = F.row_number().over(line) + F.col("before")
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    crossed = F.floor(F.col("position") * F.col("copies") + offset) - F.floor((F.col("position") - 1) * F.col("copies") + offset)
    return (
        placed.join(before, ["source", "block"])
        .withColumn("position", position)
        .withColumn("n", F.least(crossed, F.col("max_repeats").cast("bigint")))
        .filter("n > 0")
        .select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy_no"), "source", "n_tokens")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, n_copies, n_tokens, share) reached by a mix, for every target source."""
    by = mixed.groupBy("source").agg(F.count(F.when(F.col("copy_no") == 1, 1)).alias("n_docs"), F.count("*").alias("n_copies"), F.sum("n_tokens").alias("n_tokens"))
    return (
        targets.select("source", "target_share")
        .join(by, "source", "left")
        .select("source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_copies", "n_tokens")])
        .withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1))))
    )
