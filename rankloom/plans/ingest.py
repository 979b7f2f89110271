"""From tables or records to canonical entities and queries, with a quarantine of what was refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import records, tables
from rankloom.sources import readers


def numbered(df: DataFrame) -> DataFrame:
    """With row_index: an order of the rows, ascending in a file."""
    return df if "row_index" in df.columns else df.withColumn("row_index", F.monotonically_increasing_id())


def from_tables(candidates: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """candidates, jobs and rejected. Every row of either input is in exactly one of them."""
    entities, queries = tables.canonical_entities(numbered(candidates)), tables.canonical_queries(numbered(jobs))
    out, refused = {}, []
    for name, kind, rows, text, faults in (("candidates", "candidate", entities, "raw_resume_text", tables.entity_faults()), ("jobs", "job", queries, "raw_description", tables.query_faults())):
        stay, gone = tables.deduplicated(rows, "id", text, "row_index")
        good, bad = records.split_valid(stay, faults, name, kind, "id", "row_index")
        payload = F.to_json(F.struct(*[c for c in rows.columns]))
        refused += [bad, gone.select(F.lit(name).alias("source"), F.col("row_index").cast("int").alias("row_index"), F.lit(kind).alias("record_type"), F.col("id").alias("record_id"), "reason", payload.alias("payload"))]
        out[name] = good
    rejected = refused[0]
    for r in refused[1:]:
        rejected = rejected.unionByName(r)
    return out | {"rejected": rejected}


def from_records(spark: SparkSession, path: str, signals: str = "signals") -> dict[str, DataFrame]:
    """candidates (flattened) and rejected of a file of nested records, a line each. Such a file is not deduplicated."""
    rows = readers.numbered_lines(spark, path, records.record_schema(signals))
    good, bad = records.split_valid(rows, records.faults_b(signals), path, "candidate", "candidate_id", "row_index")
    return {"candidates": records.flatten_b(good, signals), "rejected": bad}


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """name and n of each part."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
