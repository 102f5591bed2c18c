"""Session construction and the shared work folder.

Everything in the package takes a ``SparkSession`` from the caller; this module only
offers a sensible local builder (tests, bench) and the lookup of the shared folder
used to cut lineage and to stage written tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "driftspark") -> SparkSession:
    """Local session with AQE, UTC session zone and Arrow enabled."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """The setting every query relies on: the session zone.

    The given tables store ``timestamp_ntz`` columns and the window edges are written as
    UTC literals. ANSI mode stays as the caller has it; where null is wanted, expressions
    use the ``try_`` functions.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting (tests, bench) gets a fresh temporary folder, which is then recorded in
    the session so that later calls agree; a cluster session must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="driftspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location under the work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
