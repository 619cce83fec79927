"""Layer tables as Parquet: appends, idempotent replacement of periods, audit rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that Spark's writers spell as %XX in names of folders.
ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")
AUDIT = "operation string, layer string, batch_id string, status string, rows_affected long, error_detail string, duration_ms long"


def names(schema: str) -> list[str]:
    """The columns of a schema in words."""
    return StructType.fromDDL(schema).names


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of a lake; empty if it isn't there yet."""
    try:
        spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces just the partitions that df has rows for, so that a rerun gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or a partition's folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partition(path: str, **values: str) -> str:
    """The folder of a partition, spelled as Spark's writers do."""
    return "/".join([path, *(f"{k}={ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in values.items())])


def audit(spark: SparkSession, path: str, rows: Sequence[tuple]) -> None:
    """Appends audit rows; a failure here never fails the job."""
    try:
        spark.createDataFrame(list(rows), AUDIT).withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    except Exception as e:  # noqa: BLE001
        print(f"audit rows were not written: {e}")
