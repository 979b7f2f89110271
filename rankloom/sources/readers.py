"""Scans: JSON Lines, CSV, JSON, Parquet, word-processor files, and the stored tables."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.records import record_schema

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}
PRECEDENCE = (".csv", ".json", ".jsonl", ".ndjson")


class SourceNotFound(FileNotFoundError):
    pass


class UnsupportedFormat(ValueError):
    pass


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that the path names, not of the driver's."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Typed records, one a line; blank lines are skipped, a malformed one ends the run."""
    return spark.read.schema(schema or record_schema()).option("mode", "FAILFAST").json(path)


def json_lines_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def numbered_lines(spark: SparkSession, path: str, schema: T.StructType, file: str | None = None) -> DataFrame:
    """Records with row_index, the physical line from 0 in their file: blank lines count but give no record. file: the name of a column for the file's path.

    Numbers come from the lines of each split (a file's part, by where it begins) and the splits before it in the same file, so they hold
    for any number of files and any size of splits, in whatever order Spark deals these out; no task sees all lines."""
    split = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"))
    lines = spark.read.text(path).select("value", split.alias("_split"), F.monotonically_increasing_id().alias("_m"))
    starts = lines.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_split.f").orderBy("_split.o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lines.join(starts.withColumn("_before", before), "_split").withColumn("row_index", F.col("_before") + F.col("_m") - F.col("_first"))
    parsed = at.filter(F.btrim("value") != "").select("_split", "row_index", "value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(*([F.col("_split.f").alias(file)] if file else []), "row_index", F.col("value").alias("raw"), "r.*")


def suffix(path: str) -> str:
    found = re.search(r"\.[A-Za-z0-9]+$", path.rstrip("/"))
    return found[0].lower() if found else ""


def table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix. CSV columns are text, to be cast leniently; JSON may be one document over several lines."""
    kind = FORMATS.get(suffix(path))
    if kind is None:
        raise UnsupportedFormat(f"no reader for {suffix(path) or path!r}")
    if not exists(spark, path):
        raise SourceNotFound(path)
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.option("multiLine", kind == "json").json(path)


def discovered(spark: SparkSession, folder: str, name: str) -> str:
    """The path of folder/name with the first suffix of PRECEDENCE that exists."""
    for s in PRECEDENCE:
        if exists(spark, path := f"{folder.rstrip('/')}/{name}{s}"):
            return path
    raise SourceNotFound(f"{folder}/{name}.*")


def parquet_or_csv(spark: SparkSession, stem: str) -> DataFrame:
    return spark.read.parquet(f"{stem}.parquet") if exists(spark, f"{stem}.parquet") else table(spark, f"{stem}.csv")


def body_records(spark: SparkSession, body: str, schema: T.StructType, key: str = "candidates") -> DataFrame:
    """Records of a request body: a JSON list, or an object that holds it under `key`."""
    one = spark.createDataFrame([(body,)], "body string")
    listed = T.ArrayType(schema)
    held = F.from_json("body", T.StructType([T.StructField(key, listed)]))[key]
    return one.select(F.explode(F.when(F.btrim("body").startswith("["), F.from_json("body", listed)).otherwise(held)).alias("r")).select("r.*")


def vectors(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """id, vector and payload (struct) of a stored embedding table."""
    return spark.read.parquet(path).withColumn("payload", F.from_json("payload", payload))


@F.pandas_udf(T.StringType())
def document_text(content: pd.Series) -> pd.Series:
    """The paragraphs of word-processor files (zipped XML), a line each."""

    def one(data: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml").decode("utf-8")
        import html

        return "\n".join(html.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S))

    return content.map(one)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of word-processor files."""
    return spark.read.format("binaryFile").load(path).select("path", document_text("content").alias("text"))
