"""Incremental merge of arriving postings, and a companion that answers new texts, as streaming queries.

The state of the merge is a summary per id (:func:`merge.summaries`), in buckets: ``ids`` by the id (its identity),
``rows`` and ``jobs`` by the identity (summaries, and the merged rows). A micro-batch reads and writes the buckets that
its ids and identities fall in, and no others; what it costs is bounded by them, not by what has arrived before. Each
written bucket is a new version under the batch's number; a manifest names the version of each bucket, so a batch that
is run again overwrites its own versions and changes nothing else, and a stream that is stopped anywhere and started
again ends in the state of one batch run. :meth:`StreamingMerge.compact` drops the versions that no manifest needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.constants import MAX_LEGS
from stellwerk.functions.text import content_hash
from stellwerk.operators.enrichment import ask
from stellwerk.operators.merge import combined, merged, summaries

ARRIVAL = ["seq", "job_id", "source", "title", "company", "city", "description", "apply_url"]


class Store:
    """A folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):  # noqa: ANN202
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._path(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


class StreamingMerge(Store):
    """The stored jobs under ``root``. ``buckets`` is fixed for a root: some thousands for a large store."""

    TABLES = ("ids", "rows", "jobs")

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        super().__init__(spark, root)
        self.buckets = buckets

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _versions(self, batch: int) -> dict[tuple[str, int], int]:
        """(table, bucket) to the batch that wrote it: two rows a bucket, whatever has arrived."""
        at = f"{self.root}/manifest/batch={batch:08d}"
        return {(r["what"], r["bucket"]): r["version"] for r in self.spark.read.parquet(at).collect()} if batch >= 0 and self.exists(at) else {}

    def _last(self) -> int:
        done = [n for n in self.names(f"{self.root}/manifest") if n.startswith("batch=")]
        return int(done[-1].partition("=")[2]) if done else -1

    def _read(self, what: str, versions: dict[tuple[str, int], int], buckets: list[int], schema: T.StructType) -> DataFrame:
        paths = [f"{self.root}/{what}/batch={versions[what, b]:08d}/bucket={b}" for b in buckets if (what, b) in versions]
        # A version without rows has no folder.
        paths = [p for p in paths if self.exists(p)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, what: str, by: str, batch: int) -> None:
        df.withColumn("bucket", self._bucket(by)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{what}/batch={batch:08d}")

    def apply(self, arrived: DataFrame, batch: int) -> None:
        at = f"{self.root}/arrivals/batch={batch:08d}"
        summaries(arrived.select(*ARRIVAL)).write.mode("overwrite").parquet(at)
        new = self.spark.read.parquet(at)
        versions = dict(self._versions(self._before(batch)))
        id_schema = T.StructType([new.schema[c] for c in ("job_id", "key", "first_seq")])
        id_buckets = self._touched(new, "job_id")
        old_ids = self._read("ids", versions, id_buckets, id_schema)
        # An id keeps the identity of its first arrival, whichever batch brings it.
        both = old_ids.withColumn("old_key", F.col("key")).unionByName(new.select("job_id", "key", "first_seq", F.lit(None).cast("string").alias("old_key")))
        ids = both.groupBy("job_id").agg(F.min_by("key", "first_seq").alias("key"), F.min("first_seq").alias("first_seq"), F.max("old_key").alias("old_key"))
        self._write(ids, "ids", "job_id", batch)
        known = self.spark.read.parquet(f"{self.root}/ids/batch={batch:08d}").drop("bucket")
        mine = known.join(new.select("job_id"), "job_id", "left_semi")
        keys = mine.select("key").unionByName(mine.filter("old_key IS NOT NULL AND old_key != key").select(F.col("old_key").alias("key")))
        key_buckets = self._touched(keys, "key")
        old_rows = self._read("rows", versions, key_buckets, new.schema)
        parts = combined(old_rows.unionByName(new.select(*old_rows.columns)))
        now = mine.select("job_id", F.col("key").alias("now"))
        rows = parts.join(now, "job_id", "left").withColumn("key", F.coalesce("now", "key")).drop("now")
        self._write(rows, "rows", "key", batch)
        stored = self.spark.read.parquet(f"{self.root}/rows/batch={batch:08d}").drop("bucket")
        self._write(merged(stored), "jobs", "dedupe_key", batch)
        versions |= {("ids", b): batch for b in id_buckets} | {(t, b): batch for t in ("rows", "jobs") for b in key_buckets}
        manifest = [(t, b, v) for (t, b), v in sorted(versions.items())]
        self.spark.createDataFrame(manifest, "what string, bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch:08d}")

    def _before(self, batch: int) -> int:
        done = [int(n.partition("=")[2]) for n in self.names(f"{self.root}/manifest") if n.startswith("batch=")]
        return max((b for b in done if b < batch), default=-1)

    def _touched(self, df: DataFrame, by: str) -> list[int]:
        """The buckets of a column's values: as many as there are buckets at most."""
        return sorted(r[0] for r in df.select(self._bucket(by)).distinct().collect())

    def compact(self, keep: int = 2) -> None:
        """Drop the versions and arrivals that the newest ``keep`` manifests do not name."""
        batches = [int(n.partition("=")[2]) for n in self.names(f"{self.root}/manifest") if n.startswith("batch=")]
        needed = {(t, v, b) for n in batches[-keep:] for (t, b), v in self._versions(n).items()}
        for t in self.TABLES:
            for folder in self.names(f"{self.root}/{t}"):
                for part in self.names(f"{self.root}/{t}/{folder}"):
                    if part.startswith("bucket=") and (t, int(folder.partition("=")[2]), int(part.partition("=")[2])) not in needed:
                        self.remove(f"{self.root}/{t}/{folder}/{part}")
        for n in batches[:-keep]:
            self.remove(f"{self.root}/manifest/batch={n:08d}")
            self.remove(f"{self.root}/arrivals/batch={n:08d}")

    def run(self, arrivals: DataFrame) -> None:
        """Take in all that has arrived, then stop."""
        arrivals.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def jobs(self) -> DataFrame:
        """The stored jobs as the newest manifest names them."""
        versions = self._versions(self._last())
        paths = [p for (t, b), v in versions.items() if t == "jobs" and self.exists(p := f"{self.root}/jobs/batch={v:08d}/bucket={b}")]
        return self.spark.read.parquet(*paths)


class Companion(Store):
    """Answers each new text once, as it arrives; answers lie under ``root/answers`` by batch.

    With ``rules`` (an answer's problem or null, such as :func:`enrichment.answer_problem`) an answer that breaks one is
    not kept, its problem is.
    """

    def __init__(self, spark: SparkSession, root: str, model: Callable, rules: Callable[[Column], Column] | None = None) -> None:
        super().__init__(spark, root)
        self.model, self.rules = model, rules

    def apply(self, arrived: DataFrame, batch: int) -> None:
        work = arrived.select("job_id", content_hash(F.col("description")).alias("text_hash"), F.col("description").alias("prompt")).filter("text_hash IS NOT NULL").dropDuplicates(["job_id", "text_hash"])
        if self.exists(f"{self.root}/answers"):
            done = self.spark.read.schema("job_id string, text_hash string, batch int").parquet(f"{self.root}/answers").filter(F.col("batch") < batch)
            work = work.join(done, ["job_id", "text_hash"], "left_anti")
        keyed = work.withColumn("key", F.concat_ws("\x1f", "job_id", "text_hash"))
        answers = ask(keyed.select(F.col("key").alias("job_id"), "prompt"), self.model)
        if self.rules is not None:
            answers = answers.withColumn("problem", F.coalesce("problem", self.rules(F.col("answer")))).withColumn("answer", F.when(F.col("problem").isNull(), F.col("answer")))
        parts = F.split("job_id", "\x1f")
        answers.select(parts[0].alias("job_id"), parts[1].alias("text_hash"), "answer", "problem").write.mode("overwrite").parquet(f"{self.root}/answers/batch={batch:08d}")

    def run(self, arrivals: DataFrame) -> None:
        arrivals.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/companion").trigger(availableNow=True).start().awaitTermination()

    def answers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/answers").drop("batch")


def stream_of(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files to a batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_until_done(leg: Callable[[int], tuple[int, bool]], most: int = MAX_LEGS) -> list[int]:
    """Run legs (leg number to found, done) until one is done or finds nothing, at most so many. Returns what each found."""
    found: list[int] = []
    while len(found) < most:
        n, done = leg(len(found))
        found.append(n)
        if done or n == 0:
            break
    return found
