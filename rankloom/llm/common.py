"""What the operators of this subpackage share: reading, intermediate tables, row-wise Arrow maps, salted prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables: spark.checkpoint.dir. Where that is unset, a session of one machine (tests) gets
    a folder of its own; on a cluster that is an error, since executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None, few: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors, is computed once.

    few: df is small beside what it is made from, so it is dealt anew into as few files as its size needs (one more shuffle of it).
    instead_of: an earlier such table that nothing but df reads; it is deleted. The codec is one without direct buffers, which
    Java frees only when its heap fills: a job with many small tables would hold far more memory than its heap."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rankloom/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if few else df).write.option("compression", "zstd").parquet(path)
    if instead_of is not None:
        dropped(instead_of)
    # The table replaces what led to it: once the driver's garbage is collected, Spark deletes those shuffle files.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.rankloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what `written` wrote. Nothing may read df, or what was made of it, any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.rankloom_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def with_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], new: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (default all) and those that fn computes of each Arrow batch, which replace any of the same name. new: name to Spark type."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in new.items()])
    kinds = {n: ARROW[t] for n, t in new.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(made[n], type=k) for n, k in kinds.items()], names=[*keep, *kinds])

    return df.mapInArrow(run, schema)


def running_total(df: DataFrame, key: str, order: str, value: str, out: str, width: int = 63, per_bucket: int = 4096) -> DataFrame:
    """Exclusive prefix sum of `value` within `key` in the order of the hash column `order` of `width` bits, without one task for each key:
    rows go to buckets of about `per_bucket` rows by the hash's high bits; a window adds up the buckets of a key, another the rows of a bucket."""
    n = df.count()
    bits = max(0, min(30, (max(1, n // per_bucket) - 1).bit_length()))
    df = df.withColumn("_bucket", F.shiftrightunsigned(F.col(order), width - bits) if bits else F.lit(0).cast("long"))
    sums = df.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b"))).withColumn(out, F.col("_start") + F.col("_in")).drop("_bucket", "_key", "_b", "_start", "_in")
