"""Session, table access, lineage cuts and shipping of the package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(app: str = "stellwerk", master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it; on a cluster the session comes from outside."""
    builder = SparkSession.builder.appName(app).master(master)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_process(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) may go without, and gets a temporary folder; elsewhere a missing setting is an error,
    as a folder of one machine would lose what the others wrote.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not _one_process(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stellwerk-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path of one's own below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{spark.sparkContext.applicationId}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers, if it is not already.

    Workers of a local session find it when its folder is on PYTHONPATH or is the working directory; else a zip of the
    code is sent. Operators whose Python functions run in workers call this themselves.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    on_path = str(ROOT) in [str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _one_process(spark) and (on_path or Path.cwd() == ROOT):
        return
    archive = Path(tempfile.mkdtemp(prefix="stellwerk-zip-")) / "stellwerk.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in (ROOT / "stellwerk").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
