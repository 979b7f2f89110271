"""Stored jobs, candidates and rankings: the functions a service would call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import records, tables
from rankloom.operators.sizes import checkpointed
from rankloom.plans import second_ranker
from rankloom.sources import readers, writers
from rankloom.sources.keyed import Keyed


class Store:
    """Tables under one folder: candidates and jobs laid out by key, of which a change rewrites and a lookup reads only the buckets
    concerned; rankings, with a partition for each query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keyed(self, name: str) -> Keyed:
        return Keyed(self.spark, self.path(name))

    def table(self, name: str) -> DataFrame:
        if (stored := self.keyed(name)).exists():
            return stored.rows()
        if not readers.exists(self.spark, self.path(name)):
            raise second_ranker.NotFound(f"no {name}")
        return self.spark.read.parquet(self.path(name))

    def save(self, name: str, rows: DataFrame) -> int:
        """Lays rows over the stored ones by id and says how many there are then. Columns that are new to the table are added."""
        self.keyed(name).upsert(rows)
        return self.table(name).count()

    def listed(self, name: str, limit: int = 100, after: str | None = None) -> DataFrame:
        """A page of a table in the order of id, from behind `after`."""
        rows = self.table(name)
        return (rows if after is None else rows.filter(F.col("id") > F.lit(after))).orderBy("id").limit(limit)

    def upload(self, name: str, path: str) -> dict[str, int]:
        """A file of candidates or jobs, by its suffix: rows that are valid are saved. Numbers of accepted and refused rows."""
        rows = readers.table(self.spark, path)
        entities = name == "candidates"
        canonical, faults = (tables.canonical_entities(rows), tables.entity_faults()) if entities else (tables.canonical_queries(rows), tables.query_faults())
        # Saved and counted from one parse of the file.
        good, bad = map(checkpointed, records.split_valid(canonical.withColumn("row_index", F.monotonically_increasing_id()), faults, path, name, "id", "row_index"))
        self.save(name, good.drop("row_index"))
        return {"accepted": good.count(), "refused": bad.count()}

    def health(self) -> dict[str, bool]:
        return {name: readers.exists(self.spark, self.path(name)) for name in ("candidates", "jobs", "rankings")}

    def one(self, name: str, key: str) -> DataFrame:
        stored = self.keyed(name)
        return (stored.rows([key]) if stored.exists() else self.table(name).filter(F.col("id") == F.lit(key))).limit(1)

    def rank(self, job_id: str, **options) -> DataFrame:
        """Ranks one query, replaces its stored results and returns them as stored."""
        results = second_ranker.rank_one(self.table("candidates"), self.table("jobs"), job_id, **options)
        writers.replace_results(results, self.path("rankings"))
        return self.results(job_id)

    def rank_all(self, **options) -> DataFrame:
        """Ranks all stored queries in one pass over the entities; job_id and n of their results."""
        results = second_ranker.rank(self.table("candidates"), self.table("jobs"), **options)
        writers.replace_results(results, self.path("rankings"))
        return self.table("rankings").groupBy("job_id").count()

    def results(self, job_id: str) -> DataFrame:
        return self.table("rankings").filter(F.col("job_id") == F.lit(job_id)).orderBy("rank")
