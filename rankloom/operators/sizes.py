"""Sizes that are measured before something is broadcast, and results that are computed once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, with a broadcast hint if it has at most about `limit` bytes. It is counted for that, so it should be cheap to compute."""
    wide = [F.octet_length(f.name) if isinstance(f.dataType, T.StringType) else F.size(f.name) * 16 for f in df.schema if isinstance(f.dataType, (T.StringType, T.ArrayType))]
    n, size = df.agg(F.count(F.lit(1)), sum([F.coalesce(F.sum(w), F.lit(0)) for w in wide], F.lit(0))).first()
    return F.broadcast(df) if n * 16 * len(df.columns) + size <= limit else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session of one machine gets a temporary one; on a cluster that is an
    error, since each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: stored results need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rankloom-")
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and cut off from what led to it, in the folder of spark.checkpoint.dir; on one machine in a temporary one where that is unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
