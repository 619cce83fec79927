"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df computed once and kept in spark.checkpoint.dir; where that is unset in a temporary folder, on one machine only (tests)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        told = context.getConf().get("spark.checkpoint.dir")
        if not told and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
