"""Tables laid out by key, kept totals, numbered lines and the choice of a reranker."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import cli
from rankloom.operators import behaviour, score
from rankloom.plans import second_ranker
from rankloom.sources import keyed, readers
from rankloom.sources.keyed import Conflict, Keyed
from rankloom.streaming.totals import Totals


def pairs(spark, rows, schema="id string, n int"):
    return spark.createDataFrame(rows, schema)


def held(table):
    return {tuple(r) for r in table.rows().collect()}


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    table = Keyed(spark, f"file://{tmp_path}/t", buckets=8)
    with pytest.raises(FileNotFoundError):
        table.rows()
    table.upsert(pairs(spark, [(f"k{i}", i) for i in range(100)] + [(None, 7), ("k3", 33)]))
    first = table.version()[1]["folders"]
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/data/*/*/*.parquet")}
    table.upsert(pairs(spark, [("k5", 55), ("new", 1), (None, 8)]))
    second = table.version()[1]["folders"]
    moved = {b for b in second if second[b] != first.get(b)}
    assert 1 <= len(moved) <= 3 and {f: os.stat(f).st_mtime_ns for f in files} == files
    assert held(table) == {(f"k{i}", {3: 33, 5: 55}.get(i, i)) for i in range(100)} | {("new", 1), (None, 8)}
    # A lookup reads the key's bucket.
    one = table.rows(["k5", None])
    assert {tuple(r) for r in one.collect()} == {("k5", 55), (None, 8)}
    assert len({f.split("_b=")[1].split("/")[0] for f in one.inputFiles()}) <= 2
    # New columns are null before, absent ones null after; the older version's folders go when they are swept.
    table.upsert(spark.createDataFrame([("k9", "x")], "id string, more string"))
    got = {r.id: (r.n, r.more) for r in table.rows().collect()}
    assert got["k9"] == (None, "x") and got["k8"] == (8, None)
    before = held(table)
    assert table.swept() > 0 and held(table) == before and len(table.numbers()) == 1


@pytest.mark.parametrize("step", ["data", "take", "half"])
def test_a_change_that_breaks_off_leaves_the_table(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(keyed, "WAIT", 0.3)
    table = Keyed(spark, f"file://{tmp_path}/t", buckets=4)
    table.upsert(pairs(spark, [("a", 1), ("b", 2)]))
    if step == "half":  # the writer dies in the middle of the version's file
        (tmp_path / "t/versions/00000002.json").write_text('{"buckets": 4, "fold')
    else:
        name = {"data": "_laid", "take": "_take"}[step]
        with monkeypatch.context() as m:
            m.setattr(Keyed, name, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                table.upsert(pairs(spark, [("a", 9), ("c", 3)]))
    assert held(table) == {("a", 1), ("b", 2)}
    table.upsert(pairs(spark, [("c", 3)]))
    assert held(table) == {("a", 1), ("b", 2), ("c", 3)}


def test_two_writers_do_not_lose_each_others_rows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    one, two = Keyed(spark, path, buckets=1), Keyed(spark, path, buckets=1)
    one.upsert(pairs(spark, [("a", 1)]))
    laid, raced = Keyed._laid, []

    def slow(self, old, new):
        if self is one and not raced:  # the other writer comes between reading and writing
            raced.append(two.upsert(pairs(spark, [("b", 2)])))
        return laid(self, old, new)

    monkeypatch.setattr(Keyed, "_laid", slow)
    one.upsert(pairs(spark, [("c", 3)]))
    assert held(two) == {("a", 1), ("b", 2), ("c", 3)} and raced == [2]
    # A number is taken once; who never gets one says so.
    version = one.version()[1]
    assert not one._take(one.numbers()[-1], version)
    monkeypatch.setattr(Keyed, "_take", lambda *a: False)
    monkeypatch.setattr(keyed, "TRIES", 2)
    with pytest.raises(Conflict):
        one.upsert(pairs(spark, [("d", 4)]))


def test_totals_grow_as_a_pass_over_all_events(spark, tmp_path):
    rows = [(f"2024-01-{1 + i % 20:02d} 10:00:00", i % 7 if i % 11 else None, ["view", "buy", "click"][i % 3], None if i % 5 == 0 else float(i % 4)) for i in range(200)]
    events = spark.createDataFrame(rows, "ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    totals = Totals(spark, f"file://{tmp_path}/t", 4)
    for upto in range(0, 20, 5):
        part = events.filter((F.dayofmonth("ts") > upto) & (F.dayofmonth("ts") <= upto + 5))
        totals.add(part, f"days {upto}")
        totals.add(part, f"days {upto}")  # repeated: changes nothing
        so_far = events.filter(F.dayofmonth("ts") <= upto + 5).groupBy("user_id").agg(F.sum(F.coalesce("value", F.lit(1.0))).alias("frequency"), F.max("ts").cast("date").alias("d"), F.count_distinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n"))
        want = so_far.select("user_id", "frequency", behaviour.recency(F.col("d"), "2024-01-31").alias("recency"), "kinds", "n")
        plain = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}
        assert plain(totals.rows("2024-01-31")) == plain(want)
        assert plain(totals.scaled("2024-01-31")) == plain(behaviour.population_scaled(want.select("user_id", "frequency", "recency"), ("frequency", "recency")))


def test_totals_follow_a_stream(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-0{1 + i % 5} 10:00:00", i % 3, "view", 1.0) for i in range(30)], "ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    totals = Totals(spark, f"file://{tmp_path}/t", 2)
    totals.follow(stream, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert {(r.user_id, r.frequency, r.n) for r in totals.rows("2024-01-31").collect()} == {(i, 10.0, 10) for i in range(3)}
    assert len(totals.stored.numbers()) == 3


def test_line_numbers_hold_for_files_and_splits(spark, tmp_path):
    want = set()
    for f in range(4):
        lines = [json.dumps({"n": 1000 * f + i}) + " " * (i % 9) if i % 4 else "" for i in range(50 * (f + 1))]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines) + "\n" * (f % 2))
        want |= {(f"{f}.jsonl", i, json.loads(x)["n"]) for i, x in enumerate(lines) if x}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1000", was):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.numbered_lines(spark, str(tmp_path), T._parse_datatype_string("n int"), "file").collect()
            assert {(os.path.basename(r.file), r.row_index, r.n) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_pair_model_can_rerank(spark):
    rows = spark.createDataFrame([("q", "short", 1), ("q", "a much longer text", 2), ("q", None, 3)], "a string, b string, i int")

    def load():
        return lambda some: [float(len(b) - len(a)) for a, b in some]

    got = {r.i: r.s for r in rows.select("i", score.rerank_by_model(F.col("a"), F.col("b"), load).alias("s")).collect()}
    assert got[1] == pytest.approx(1 / (1 + 2.718281828459045**-4)) and got[2] > got[1] > 0.5 > got[3]


def test_whole_texts_are_reranked(spark):
    rows = spark.createDataFrame([("needle thread", "hay " * 300 + "needle thread"), ("needle thread", "hay " * 3)], "a string, b string")
    assert [r.s == 1.0 for r in rows.select(score.rerank_offline(F.col("a"), F.col("b")).alias("s")).collect()] == [True, False]


def test_reranked_keeps_ties_in_their_order(spark):
    rows = spark.createDataFrame([("j", f"c{i}", c, i, r) for i, (c, r) in enumerate([(0.5, 0.1), (0.9, 0.0), (0.5, 0.1), (0.1, 0.9)])], "job_id string, id string, composite double, place int, r double")
    got = [(r.id, r.original_rank, r["rank"]) for r in second_ranker.reranked(rows, F.col("r"), 0.5, 3).orderBy("rank").collect()]
    assert got == [("c3", 4, 1), ("c1", 1, 2), ("c0", 2, 3)]


def test_compare_command_and_settings(spark, tmp_path, monkeypatch):
    rows = lambda ids: spark.createDataFrame([("j", c, i + 1) for i, c in enumerate(ids)], "job_id string, candidate_id string, rank int")
    rows("abc").write.parquet(f"{tmp_path}/base.parquet")
    rows("cab").write.parquet(f"{tmp_path}/system.parquet")
    spark.createDataFrame([("j", "c", 2)], "job_id string, candidate_id string, rel int").write.parquet(f"{tmp_path}/judged.parquet")
    said = cli.main(["compare", "--baseline", f"{tmp_path}/base.parquet", "--system", f"{tmp_path}/system.parquet", "--judgments", f"{tmp_path}/judged.parquet"], spark)
    assert said["MRR"] == {"baseline": pytest.approx(1 / 3, abs=1e-6), "system": 1.0, "delta": pytest.approx(2 / 3, abs=1e-6)}
    monkeypatch.setenv("RANKLOOM_POOL", "77")
    monkeypatch.setenv("RANKLOOM_WAREHOUSE", "/somewhere")
    a = cli.parser().parse_args(["match"])
    assert (a.pool, a.store, a.alpha) == (77, "/somewhere", 0.5)
