import json

import pytest
from pyspark.sql import functions as F

from rankloom import cli
from rankloom.plans import fixtures
from rankloom.plans.settings import Providers, Settings, UnknownProvider
from rankloom.plans.store import Store
from rankloom.sources import writers
from tests.test_plans import record


def test_commands_from_seed_to_metrics(spark, tmp_path):
    run = lambda *a: cli.main(list(map(str, a)), spark)
    run("seed", "--folder", tmp_path / "in")
    assert run("ingest", "--folder", tmp_path / "in", "--out", tmp_path / "clean") == {"candidates": 3, "jobs": 2, "rejected": 0}
    assert run("load", "--folder", tmp_path / "in", "--store", tmp_path / "store") == {"candidates": 3, "jobs": 2}
    assert set(run("match", "--store", tmp_path / "store")) == {"t1", "t2"}
    found = run("results", "--store", tmp_path / "store", "--job", "t1")["results"]
    # Uploaded tables have no history, so stated years without one count as inconsistent: s1 comes after s3, which states none.
    assert [(r["candidate_id"], r["rank"]) for r in found] == [("s3", 1), ("s1", 2)]
    assert run("export", "--store", tmp_path / "store", "--job", "t1", "--out", tmp_path / "out.csv")["rows"] == len(found)
    store = Store(spark, str(tmp_path / "store"))
    store.table("rankings").write.parquet(str(tmp_path / "r.parquet"))
    metrics = run("evaluate", "--results", tmp_path / "r.parquet", "--judgments", tmp_path / "in/judgments.csv", "--out", tmp_path / "m")
    assert metrics["mrr"] == 0.25 and 0 < metrics["composite"] <= 1  # rank 2 in one of two jobs
    assert [r.id for r in store.listed("candidates", 2).collect()] == ["s1", "s2"] and [r.id for r in store.listed("candidates", 2, "s2").collect()] == ["s3"]
    assert store.health() == {"candidates": True, "jobs": True, "rankings": True}
    assert store.upload("candidates", str(tmp_path / "in/candidates.csv")) == {"accepted": 3, "refused": 0}


def test_rank_command_keeps_its_table(spark, tmp_path):
    path = tmp_path / "records.jsonl"
    path.write_text("".join(json.dumps(record(i)) + "\n" for i in range(1, 6)))
    run = lambda *more: cli.main(["rank", "--candidates", str(path), "--cache", str(tmp_path / "cache"), "--out", str(tmp_path / "top"), "--top", "3", *more], spark)
    first = run()
    assert first["records"] == 5 and first["flagged_ok"] and not first["over_budget"]
    made = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "cache").iterdir()}
    run()
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "cache").iterdir()} == made
    path.write_text(json.dumps(record(9)) + "\n")
    assert run()["records"] == 1 and len(list((tmp_path / "cache").iterdir())) == 2
    said = cli.main(["validate", "--file", str(tmp_path / "top"), "--size", "1"], spark)
    assert said == {"valid": True, "faults": {}}
    assert not cli.main(["validate", "--file", str(tmp_path / "top"), "--size", "2"], spark)["valid"]


def test_settings_and_providers():
    s = Settings.read({"RANKLOOM_ALPHA": "0.25", "RANKLOOM_PROVIDER": "mine", "RANKLOOM_KEY_MINE": "secret", "RANKLOOM_TOP": "", "OTHER": "x"})
    assert (s.alpha, s.provider, s.top, s.keys["mine"]) == (0.25, "mine", 20, "secret") and "secret" not in repr(s)
    providers = Providers()
    providers.register("mine", lambda settings: lambda prompt: prompt + settings.keys["mine"], needs_key=True)
    assert providers.get(s)("a") == "asecret"
    assert providers.get(Settings.read({}), "mine") is None
    with pytest.raises(UnknownProvider):
        providers.get(s, "nobody")


def test_a_broken_off_replacement_is_found_again(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark, spark.createDataFrame([("a", 1)], "id string, n int"), path, "id")
    (tmp_path / "t").rename(tmp_path / "t.old")
    writers.upsert(spark, spark.createDataFrame([("b", 2, "x")], "id string, n int, more string"), path, "id")
    assert {(r.id, r.n, r.more) for r in spark.read.parquet(path).collect()} == {("a", 1, None), ("b", 2, "x")}
    assert not (tmp_path / "t.old").exists()


def test_fixtures_have_judged_pairs_only(spark):
    t = fixtures.tables(spark)
    assert t["judgments"].join(t["candidates"], "candidate_id").join(t["jobs"], "job_id").count() == t["judgments"].count()
    assert t["candidates"].filter(F.col("skills") == "").count() == 1
