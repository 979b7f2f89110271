"""A few invented rows to try the library on: three candidates, two jobs and judgments of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CANDIDATES = [
    ("s1", "Summary\nBuilds search services.\nSkills\nPython, FastAPI, Qdrant\nExperience\nSenior Engineer at Lantern, Jan 2019 - Mar 2023\n- Deployed semantic search to production users.", "Python|FastAPI|Qdrant", "6", "Pune", "https://example.org/s1", '{"github_activity_score": 40, "notice_period_days": 15}'),
    ("s2", "Skills\nSQL, ETL\nExperience\nData Engineer at Harbour, 2020 - 2022\n- Built data pipelines.", "SQL|ETL", "2.5", "Oslo", "", "{}"),
    ("s3", "Profile\nTeaches music and writes songs.", "", "", "", "", ""),
]
JOBS = [
    ("t1", "Senior Search Engineer", "We build search with Python and vector databases for many users.", "Python|vector databases", "FastAPI", "senior", "Pune"),
    ("t2", "Data Engineer", "Own our pipelines. Required: SQL, ETL. Preferred: Python.", "", "", "mid", ""),
]
JUDGMENTS = [("t1", "s1", 3), ("t1", "s2", 0), ("t2", "s2", 2)]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """candidates and jobs as uploaded tables have them (all text), and judgments (job_id, candidate_id, rel)."""
    text = lambda names: ", ".join(f"{n} string" for n in names.split())
    return {
        "candidates": spark.createDataFrame(CANDIDATES, text("candidate_id resume skills years_experience city github metadata")),
        "jobs": spark.createDataFrame(JOBS, text("job_id job_title description required_skills preferred_skills level city")),
        "judgments": spark.createDataFrame(JUDGMENTS, "job_id string, candidate_id string, rel int"),
    }


def seed(spark: SparkSession, folder: str) -> None:
    """The tables as CSV files under folder."""
    for name, df in tables(spark).items():
        df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder.rstrip('/')}/{name}.csv")
