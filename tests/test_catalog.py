"""Every query against its SQL, as the driver compares them, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BASE = entry.catalog.QUERIES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(BASE))
def test_query(spark, db, name):
    df = BASE[name](spark, FOLDER)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name not in entry.catalog.SQL:
        assert rows
        return
    got = db.execute(entry.catalog.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in got.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lines_of_one_number_stay_as_stored(spark, db, tmp_path):
    db.execute(f"COPY (SELECT * REPLACE (1 AS l_orderkey, k AS l_partkey, 5 AS l_linenumber, 'R' AS l_returnflag, 1.0 AS l_quantity) FROM (SELECT * FROM lineitem LIMIT 1), (VALUES (9), (10), (8)) t(k)) TO '{tmp_path}/lineitem.parquet'".replace("SELECT * REPLACE (", "SELECT * EXCLUDE k REPLACE ("))
    db.execute(f"COPY (SELECT * REPLACE (1 AS o_orderkey) FROM orders LIMIT 1) TO '{tmp_path}/orders.parquet'")
    for name, flag in (("inconsistency_flags_a", "expert_zero_duration"), ("inconsistency_flags_b", "expert_skill_zero_duration")):
        flags = BASE[name](spark, str(tmp_path)).first().flags.split(";")
        assert [f for f in flags if f.startswith(flag)] == [f"{flag}:{k}" for k in (9, 10, 8)]


def test_lines_without_a_number_or_a_whole_quantity(spark, db, tmp_path):
    """As the SQL has them, in one thread: ties are as stored there."""
    lines = [(1, 9, None, "R", 1.0), (1, 8, 2, "R", 1.5), (1, 7, 1, "R", None), (2, 6, 1, "R", None), (3, 5, 1, "R", 2.5), (3, 4, 1, "R", 0.5), (4, 3, 1, "R", 0.6), (4, 2, 1, None, 72.6), (5, None, 1, "R", 1.0), (None, 1, 1, "R", 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 20000.0), (2, 20000.0), (3, 0.0), (4, 62500.0), (5, None), (6, 1.0)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect(config={"threads": 1})
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("inconsistency_flags_a", "inconsistency_flags_b"):
        assert sorted(map(tuple, BASE[name](spark, str(tmp_path)).collect()), key=str) == sorted(con.execute(entry.catalog.SQL[name]).fetchall(), key=str)


@pytest.mark.parametrize("name, joins", [("hybrid_shortlist", 1), ("second_shortlist", 2), ("rerank_blend", 1)])
def test_shortlists_leave_the_documents_where_they_are(spark, name, joins):
    """Joined with short lists, documents are neither sorted nor dealt out by their ids."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= joins
