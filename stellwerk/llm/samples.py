"""Bounded samples of distinct texts to fit classifiers on, and fitting in a task instead of on the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 40


def distinct_texts(df: DataFrame, text: str, limit: int, key: str | None = None) -> DataFrame:
    """(mark, text, and the least ``key``) of at most ``limit`` distinct texts, those of the smallest hash.

    The distinct texts are estimated first, so that each task lets through only what has a chance to be chosen; copies
    are made one in each task before anything is sent. However often a text is repeated, it is one of the sample.
    """
    mark = F.pmod(F.xxhash64(text), F.lit(_SPAN))
    rows = df.filter(F.length(text) > 0).select(mark.alias("mark"), text, *([key] if key else []))
    n = rows.agg(F.approx_count_distinct("mark", 0.02)).first()[0]
    if n > 2 * limit:
        rows = rows.filter(F.col("mark") < int(_SPAN * 1.3 * limit / n + 1))
    best = rows.groupBy("mark", text).agg(*([F.min(key).alias(key)] if key else [F.lit(0).alias("_")])).drop("_")
    return best.orderBy("mark", text).limit(limit)


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """``fit`` of the rows of a bounded sample, run in one task; what comes back is the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").first()
    # Of an empty sample there is no task.
    return pickle.loads(got[0]) if got else fit([])
