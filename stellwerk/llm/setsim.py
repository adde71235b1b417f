"""Set-similarity join by prefix filtering.

Tokens are ordered by global rarity; of each set only the rarest tokens that any partner with the wanted Jaccard
similarity must share (its prefix) are joined; length and positional filters drop most pairs before their sets are
compared; what is left is verified exactly. Nothing is sampled or capped, and no pair is formed but by a shared
rare token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, q: int = 2) -> Column:
    """The distinct q-grams of a string with its ends marked; the empty string has none."""
    marked = F.concat(F.lit("^" * (q - 1)), text, F.lit("$" * (q - 1)))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - (q - 1)), lambda i: F.substring(marked, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def _ordered(sets: DataFrame, key: str, tokens: str, rarity: DataFrame, threshold: float) -> DataFrame:
    """(key, set, size, pos, token): the prefix tokens of each set, rarest first."""
    return (
        sets.select(F.col(key).alias("key"), F.explode(tokens).alias("token"))
        .join(rarity, "token")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        .select("key", F.col("ranked.token").alias("set"), F.size("ranked").alias("size"))
        .select("key", "set", "size", F.posexplode(F.slice("set", F.lit(1), F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1)).alias("pos", "token"))
    )


def similarity_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, threshold: float) -> DataFrame:
    """All pairs ``(left_key, right_key, jaccard)`` with a Jaccard similarity of ``threshold`` or more.

    Both sides have a unique key and an array of distinct tokens in the column ``tokens``. Empty or null sets match
    nothing.
    """
    rarity = left.select(F.explode(tokens).alias("token")).unionByName(right.select(F.explode(tokens).alias("token"))).groupBy("token").agg(F.count("*").alias("n"))
    a = _ordered(left, left_key, tokens, rarity, threshold).select("token", *[F.col(c).alias(f"l_{c}") for c in ("key", "set", "size", "pos")])
    b = _ordered(right, right_key, tokens, rarity, threshold).select("token", *[F.col(c).alias(f"r_{c}") for c in ("key", "set", "size", "pos")])
    least = F.ceil((F.col("l_size") + F.col("r_size")) * (threshold / (1 + threshold)) - 1e-9)
    most = F.least(F.col("l_size") - F.col("l_pos"), F.col("r_size") - F.col("r_pos"))
    pairs = a.join(
        b,
        (a["token"] == b["token"]) & (F.col("r_size") >= F.col("l_size") * threshold - 1e-9) & (F.col("l_size") >= F.col("r_size") * threshold - 1e-9) & (most >= least),
    )
    # Sets are compared where they meet, so that only keys are shuffled to drop pairs that met more than once.
    shared = F.size(F.array_intersect("l_set", "r_set"))
    return (
        pairs.select("l_key", "r_key", (shared / (F.col("l_size") + F.col("r_size") - shared)).alias("jaccard"))
        .filter(F.col("jaccard") >= threshold - 1e-9)
        .dropDuplicates(["l_key", "r_key"])
        .select(F.col("l_key").alias(left_key), F.col("r_key").alias(right_key), "jaccard")
    )
