"""Intermediate tables in the folder that all executors share, and broadcasts behind a count."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again, so that its plan runs once however often it is used.

    Only a local master may do without that setting.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    path = os.path.join(base, f"gristmill-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if a count finds at most ``most`` rows; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
