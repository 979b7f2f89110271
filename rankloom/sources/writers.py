"""Sinks: Parquet, JSON, CSV, and stored tables with upsert and replacement by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.sources.readers import exists


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for stores without them."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One record a line, keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def single_json(df: DataFrame, path: str) -> None:
    """One file; for results of a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def vectors(df: DataFrame, path: str) -> None:
    """id, vector and payload, the latter as JSON."""
    df.select("id", "vector", F.to_json("payload").alias("payload")).write.mode("overwrite").parquet(path)


def result_csv(df: DataFrame, path: str) -> None:
    """candidate_id, rank, score, reasoning of a top list, in one file in rank order."""
    df.select("candidate_id", "rank", "score", "reasoning").orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def per_query(results: DataFrame, query: str, order: str) -> DataFrame:
    """query and results: its rows as an array in order."""
    rest = [c for c in results.columns if c not in (query, order)]
    return results.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("results"))


def _paths(spark: SparkSession, *paths: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(conf), made


def recovered(spark: SparkSession, path: str) -> None:
    """Puts a table back whose replacement broke off between its two moves."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        fs, (now, old) = _paths(spark, path, f"{path}.old")
        fs.rename(old, now)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str) -> None:
    """Stored rows with those of `new` laid over them by key; the last of several new ones counts. One writer at a time.

    Written beside; then the old table moves away and the new one in, so at any moment one of them is whole, and `recovered` finds it."""
    recovered(spark, path)
    new = new.withColumn("_seq", F.monotonically_increasing_id())
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_seq")))).filter("_n = 1").drop("_n", "_seq")
    rows = spark.read.parquet(path).join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True) if exists(spark, path) else new
    rows.write.mode("overwrite").parquet(f"{path}.next")
    fs, (now, old, fresh) = _paths(spark, path, f"{path}.old", f"{path}.next")
    fs.delete(old, True)
    if fs.exists(now):
        fs.rename(now, old)
    fs.rename(fresh, now)
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def replace_results(results: DataFrame, path: str, query: str = "job_id") -> None:
    """Replaces the results of the queries in `results` and leaves those of others: a partition for each query."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(query).parquet(path)
