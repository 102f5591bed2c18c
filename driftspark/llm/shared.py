"""Helpers shared by the operators: the shared folder, staged tables, joins on id sets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bound of a broadcast id set: 2 million 8-byte keys are about 32 MB as a hash relation.
BROADCAST_IDS = 2_000_000
# Bytes of an Arrow batch to Python where rows hold texts or packed arrays.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; tests set one before calling."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as zstd Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads the files instead of recomputing.
    The files stay until the application calls ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Batches of at most about ``size`` bytes to Python in what is run inside; the session's own
    bound holds again after it. Wide rows else make batches of 10,000, tens of MB that the JVM
    and the worker both hold, some more than once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Delete every table this application staged. Call it after the last action."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/llm-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(ids: DataFrame, bound: int = BROADCAST_IDS) -> bool:
    """Whether ``ids`` (a staged or cheap frame) has at most ``bound`` rows."""
    return ids.count() <= bound


def on_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of wide rows with a set of ids.

    The id set is broadcast only when its counted size is under the bound, so that the
    wide rows need no shuffle; a larger set takes a shuffled join.
    """
    keys = ids.select(key).distinct()
    return df.join(F.broadcast(keys) if small(keys) else keys, key, how)
