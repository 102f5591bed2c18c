"""Sources and sinks.

Large data is read and written as Parquet with explicit partitioning; the small logs
of the loop (metrics, training runs, reports) are appended as long-form Parquet so a
later change of columns cannot misalign rows (G12). Paths live under the shared work
folder of the session unless the caller names one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet scan of a directory tree. Partition columns are discovered with
    type inference (``dt`` → date, ``hour`` → int) unless a schema pins them."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None,
                      mode: str = "append") -> None:
    """Shuffle on the partition keys first, so each output directory gets few
    files, then a partitioned append.

    The shuffle is a ``rebalance`` on the keys: AQE splits a partition value that holds
    a large share of the rows over several tasks (and files) and merges small ones, so
    one hot ``dt``/``account_type`` does not end up in a single writer task. With
    ``partitions`` a plain hash repartition to that count is used instead.
    """
    x = df.repartition(partitions, *keys) if partitions else df.hint("rebalance", *keys)
    x.write.mode(mode).partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header row, explicit schema, empty cells → null."""
    return (spark.read.option("header", True).option("mode", "PERMISSIVE")
            .option("nullValue", "").schema(schema).csv(path))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows of a log with a fixed (long) schema."""
    df.write.mode("append").parquet(path)


def stack_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, columns matched by name, missing ones null."""
    return a.unionByName(b, allowMissingColumns=True)


def is_empty(df: DataFrame) -> bool:
    """Emptiness without scanning more than one row."""
    return df.isEmpty()


def wide_view(metrics: DataFrame, keys: Sequence[str], metric: str = "pvalue") -> DataFrame:
    """The one-row-per-cycle layout (``p_<column>`` sorted) from the long log."""
    m = metrics.where(F.col("metric") == metric).withColumn("_c", F.concat(F.lit("p_"), F.col("column")))
    return m.groupBy(*keys).pivot("_c").agg(F.first("value"))
