"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of short columns that every executor may hold a copy of.
BROADCAST_ROWS = 200_000

# Folder per application that runs on one machine.
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(
    app: str = "fleetgrid", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings the package relies on; ``settings`` win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or a local one when the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="fleetgrid-")
    return _LOCAL_FOLDERS[context.applicationId]


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_folder(spark)}/fleetgrid/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint that outlives executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``BROADCAST_ROWS`` rows; else leave the join to Spark.

    Without a known row count ``df`` is counted, so it should be durable or cheap.
    """
    count = df.count() if rows is None else rows
    return F.broadcast(df) if count <= BROADCAST_ROWS else df
