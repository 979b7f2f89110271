"""Tables kept beside what they were made from, and made again when that changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.sources.readers import exists


def fingerprint(spark: SparkSession, source: str, version: str) -> str:
    """Of the names, lengths and times of a source's files, and of what makes the table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    seen = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.sha256(repr((version, seen)).encode()).hexdigest()[:24]


def cached(spark: SparkSession, source: str, folder: str, make: Callable[[], DataFrame], version: str = "1", rebuild: bool = False) -> DataFrame:
    """The table `make` makes of `source`, stored under `folder` by the source's fingerprint. A table counts only once it is whole."""
    path = f"{folder.rstrip('/')}/{fingerprint(spark, source, version)}"
    if rebuild or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
