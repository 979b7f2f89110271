"""Commands: python -m rankloom.cli rank | ingest | load | match | results | export | evaluate | compare | validate | seed. Each prints what it did as JSON."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rankloom.plans.settings import Settings

#: Seconds that a ranking run should stay below, and from which on it says so.
BUDGET, WARNING = 300.0, 240.0


def session() -> SparkSession:
    return SparkSession.builder.appName("rankloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def rank(a: argparse.Namespace, spark: SparkSession) -> dict:
    """Records to a top list for one fixed query, over a cached table of flat rows."""
    from rankloom.operators import evaluate, records
    from rankloom.plans import first_ranker
    from rankloom.plans.cache import cached
    from rankloom.sources import readers, writers

    began = time.time()

    def flat():
        good, _ = records.split_valid(readers.json_lines(spark, a.candidates, records.record_schema(a.signals)).withColumn("_row", F.monotonically_increasing_id()), records.faults_a(a.signals), "records", "candidate", "candidate_id", "_row")
        return records.flatten_a(good.drop("_row"), a.signals)

    table = cached(spark, a.candidates, a.cache, flat, rebuild=a.force_rebuild_cache) if a.cache else flat()
    n, loaded = table.count(), time.time()
    top = first_ranker.ranked(table, **({"query": a.query} if a.query else {}), top=a.top).persist()
    writers.result_csv(top, a.out)
    share = evaluate.flagged_share(top, "flagged").first()[0] or 0.0
    ended = time.time()
    return {"records": n, "load_s": round(loaded - began, 3), "score_s": round(ended - loaded, 3), "total_s": round(ended - began, 3), "slow": ended - began > WARNING, "over_budget": ended - began > BUDGET, "flagged_share": round(share, 4), "flagged_ok": share <= 0.1, "out": a.out}


def _tables(spark: SparkSession, folder: str):
    from rankloom.plans import ingest
    from rankloom.sources import readers

    return ingest.from_tables(*[readers.table(spark, readers.discovered(spark, folder, n)) for n in ("candidates", "jobs")])


def ingest_(a: argparse.Namespace, spark: SparkSession) -> dict:
    """Tables of candidates and jobs to canonical Parquet with a quarantine."""
    from rankloom.plans import ingest
    from rankloom.sources import writers

    parts = _tables(spark, a.folder)
    for name, df in parts.items():
        writers.parquet(df, f"{a.out.rstrip('/')}/{name}.parquet")
    return {r.name: r.n for r in ingest.counts(parts).collect()}


def load(a: argparse.Namespace, spark: SparkSession) -> dict:
    """Tables of candidates and jobs into a store."""
    from rankloom.plans.store import Store

    store, parts = Store(spark, a.store), _tables(spark, a.folder)
    return {name: store.save(name, parts[name].drop("row_index")) for name in ("candidates", "jobs")}


def match(a: argparse.Namespace, spark: SparkSession) -> dict:
    """Ranks a stored job, or all of them, and stores the results."""
    from rankloom.plans.store import Store

    store, options = Store(spark, a.store), {"alpha": a.alpha, "top": a.top, "pool": a.pool, "as_of": a.as_of}
    if a.job:
        return {a.job: store.rank(a.job, **options).count()}
    return {r[0]: r[1] for r in store.rank_all(**options).collect()}


def results(a: argparse.Namespace, spark: SparkSession) -> dict:
    from rankloom.plans.store import Store

    return {"job": a.job, "results": [json.loads(x) for x in Store(spark, a.store).results(a.job).toJSON().take(a.limit)]}


def export(a: argparse.Namespace, spark: SparkSession) -> dict:
    """A stored job's results as a result file."""
    from rankloom.plans.store import Store
    from rankloom.sources import writers

    found = Store(spark, a.store).results(a.job).filter(F.col("rank") <= a.top)
    writers.result_csv(found.select("candidate_id", "rank", F.round("final_score", 6).alias("score"), F.col("narrative").alias("reasoning")), a.out)
    return {"job": a.job, "rows": found.count(), "out": a.out}


def _read(spark: SparkSession, path: str):
    from rankloom.sources import readers

    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else readers.table(spark, path)


def _ranking(spark: SparkSession, path: str):
    return _read(spark, path).select("job_id", "candidate_id", F.col("rank").cast("int").alias("rank"))


def _judgments(spark: SparkSession, path: str):
    return _read(spark, path).select("job_id", "candidate_id", F.col("rel").cast("int").alias("rel"))


def compare(a: argparse.Namespace, spark: SparkSession) -> dict:
    """Metrics of two rankings (job_id, candidate_id, rank) against judgments: baseline, system and what lies between."""
    from rankloom.operators import evaluate
    from rankloom.sources import writers

    found = evaluate.compared(_ranking(spark, a.baseline), _ranking(spark, a.system), _judgments(spark, a.judgments), "job_id", "candidate_id", a.k)
    if a.out:
        writers.single_json(found, a.out)
    return {r.metric_name: {"baseline": round(r.baseline_score, 6), "system": round(r.system_score, 6), "delta": round(r.delta, 6)} for r in found.collect()}


def evaluate_(a: argparse.Namespace, spark: SparkSession) -> dict:
    """Metrics of results (job_id, candidate_id, rank) against judgments (job_id, candidate_id, rel)."""
    from rankloom.operators import evaluate
    from rankloom.sources import writers

    rows, judgments = _ranking(spark, a.results), _judgments(spark, a.judgments)
    found = evaluate.summary(rows, judgments, "job_id", "candidate_id")
    if a.out:
        writers.single_json(found, a.out)
    return {k: round(v, 6) for k, v in found.first().asDict().items()}


def validate(a: argparse.Namespace, spark: SparkSession) -> dict:
    """Faults of a result file."""
    from rankloom.operators import evaluate

    table = spark.read.option("header", True).option("escape", '"').csv(a.file)
    if table.columns != ["candidate_id", "rank", "score", "reasoning"]:
        return {"valid": False, "faults": {"header": 1}}
    faults = {r.fault: r.n for r in evaluate.result_faults(table, a.size).collect()}
    return {"valid": not faults, "faults": faults}


def seed(a: argparse.Namespace, spark: SparkSession) -> dict:
    from rankloom.plans import fixtures

    fixtures.seed(spark, a.folder)
    return {"folder": a.folder}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankloom")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, **options) -> None:
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for option, given in options.items():
            p.add_argument("--" + option.replace("_", "-"), **given)
        p.set_defaults(run=run)

    # What the environment sets is the default of what a command is told.
    s = Settings.read()
    stored = {"default": s.warehouse}
    need, text, whole = {"required": True}, {"default": None}, lambda n: {"type": int, "default": n}
    add("rank", rank, candidates=need, out=need, cache=text, query=text, signals={"default": "signals"}, top=whole(100), force_rebuild_cache={"action": "store_true"})
    add("ingest", ingest_, folder=need, out=need)
    add("load", load, folder=need, store=stored)
    add("match", match, store=stored, job=text, alpha={"type": float, "default": s.alpha}, top=whole(s.top), pool=whole(s.pool), as_of={"default": s.as_of})
    add("results", results, store=stored, job=need, limit=whole(100))
    add("export", export, store=stored, job=need, out=need, top=whole(10))
    add("evaluate", evaluate_, results=need, judgments=need, out=text)
    add("compare", compare, baseline=need, system=need, judgments=need, k=whole(5), out=text)
    add("validate", validate, file=need, size=whole(100))
    add("seed", seed, folder=need)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    said = a.run(a, spark or session())
    print(json.dumps(said, default=str))
    return said


if __name__ == "__main__":
    main()
