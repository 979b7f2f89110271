"""Named queries of readers, writers, canonical rows, texts and single features, with their SQL.

Readers and writers are queried by round trips: rows of a table are written under a fresh folder and read back, and SQL says
what must come out. Folders lie in spark.checkpoint.dir, or on one machine in a temporary folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behaviour, embed, evaluate, explain, index, parse, records, score, tables
from rankloom.operators.sizes import shared_folder
from rankloom.plans import catalog_records, ingest
from rankloom.plans.store import Store
from rankloom.sources import readers, writers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rankloom/io-{uuid.uuid4().hex}"


def r6(col):
    return F.round(col, 6)


QUERIES: dict = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


# ---- scans and sinks


@query("SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal FROM customer")
def json_lines_scan(spark, sf_dir):
    folder, rows = fresh(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    writers.json_lines(rows, f"{folder}/c.jsonl")
    return readers.json_lines(spark, f"{folder}/c.jsonl", rows.schema)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 + n_nationkey // 5 AS row_index, n_name FROM nation")
def numbered_lines_scan(spark, sf_dir):
    """A blank line stands before every fifth record but the first: it counts and gives none."""
    n = table(spark, sf_dir, "nation")
    line = F.concat(F.when((F.col("n_nationkey") % 5 == 0) & (F.col("n_nationkey") > 0), "\n").otherwise(""), F.to_json(F.struct("n_name")))
    path = f"{fresh(spark)}/n.jsonl"
    n.orderBy("n_nationkey").select(line.alias("value")).coalesce(1).write.text(path)
    return readers.numbered_lines(spark, path, n.select("n_name").schema).select("row_index", "n_name")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_type FROM part")
def csv_scan(spark, sf_dir):
    folder = fresh(spark)
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").write.option("header", True).csv(f"{folder}/part.csv")
    return readers.table(spark, readers.discovered(spark, folder, "part"))


@query("SELECT n_nationkey, n_name FROM nation")
def request_body_scan(spark, sf_dir):
    """A body of 25 rows: a request fits the driver by its nature."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    body = json.dumps({"candidates": [r.asDict() for r in n.collect()]})
    return readers.body_records(spark, body, n.schema)


@query("SELECT vec_id AS id, label, len(embedding) AS dims FROM embeddings")
def vector_table(spark, sf_dir):
    path = f"{fresh(spark)}/v.parquet"
    writers.vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.struct("label").alias("payload")), path)
    return readers.vectors(spark, path, "label int").select("id", F.col("payload.label").alias("label"), F.size("vector").cast("long").alias("dims"))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey < 5 THEN 'new' ELSE s_name END AS name, CASE WHEN s_nationkey < 5 THEN s_nationkey END AS more FROM supplier")
def upsert_and_evolve(spark, sf_dir):
    """Rows laid over stored ones by key, with a column that the table did not have."""
    path, s = f"{fresh(spark)}/suppliers", table(spark, sf_dir, "supplier")
    writers.upsert(spark, s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path, "id")
    writers.upsert(spark, s.filter("s_nationkey < 5").select(F.col("s_suppkey").alias("id"), F.lit("new").alias("name"), F.col("s_nationkey").alias("more")), path, "id")
    return spark.read.parquet(path)


@query("SELECT o_orderpriority AS job_id, count(*) AS n, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END)::BIGINT AS fresh FROM orders WHERE o_orderpriority <> '2-HIGH' OR o_orderstatus = 'O' GROUP BY ALL")
def replace_results(spark, sf_dir):
    """Results of one query replaced, those of others untouched."""
    path, o = f"{fresh(spark)}/rankings", table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("job_id"), "o_orderkey", "o_orderstatus")
    writers.replace_results(o.withColumn("fresh", F.lit(0)), path)
    writers.replace_results(o.filter("job_id = '2-HIGH' and o_orderstatus = 'O'").withColumn("fresh", F.lit(1)), path)
    return spark.read.parquet(path).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("fresh").alias("fresh"))


@query("SELECT candidate_id, rank::VARCHAR AS rank, reasoning FROM (SELECT lpad(doc_id::VARCHAR, 7, '0') AS candidate_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, source || ', \"' || lang || '\"' AS reasoning FROM documents) WHERE rank <= 100")
def result_file(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat("source", F.lit(', "'), "lang", F.lit('"')).alias("reasoning"), F.lit(0).alias("q"))
    top = index.top_k(d, 100, "q", [F.desc("n_chars"), F.asc("doc_id")])
    path = f"{fresh(spark)}/r.csv"
    writers.result_csv(top.select(F.lpad(F.col("doc_id").cast("string"), 7, "0").alias("candidate_id"), "rank", F.lit(0.5).alias("score"), "reasoning"), path)
    return spark.read.option("header", True).option("escape", "\\").csv(path).select("candidate_id", "rank", "reasoning")


@query("SELECT o_custkey, to_json(list(o_orderkey ORDER BY o_orderkey))::VARCHAR AS keys FROM orders GROUP BY o_custkey")
def nested_as_json(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return writers.flat(lists)


@query("SELECT s_suppkey::VARCHAR AS id FROM supplier WHERE s_suppkey::VARCHAR > '2' ORDER BY 1 LIMIT 5")
def store_page(spark, sf_dir):
    store = Store(spark, fresh(spark))
    store.save("candidates", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name"))
    return store.listed("candidates", 5, after="2").select("id")


# ---- canonical rows and texts


@query("SELECT p_partkey::VARCHAR AS id, trim(p_name) AS raw_resume_text, array_to_string(string_split(p_type, ' '), '|') AS skills, p_size::DOUBLE AS years, nullif(trim(p_brand), '') AS location FROM part")
def canonical_entities(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("resume_text"), F.replace("p_type", F.lit(" "), F.lit(", ")).alias("skill_list"), F.col("p_size").alias("yoe"), F.col("p_brand").alias("city"))
    c = tables.canonical_entities(p)
    return c.select("id", "raw_resume_text", F.array_join("skills_raw", "|").alias("skills"), F.col("experience_years").alias("years"), "location")


@query("SELECT o_orderkey::VARCHAR AS id, trim(o_orderpriority) AS title, 'Order of customer ' || o_custkey AS raw_description, o_orderstatus || '|' || o_orderpriority AS must, CASE WHEN o_custkey % 2 = 0 THEN 'even' END AS seniority, concat_ws(';', CASE WHEN length('Order of customer ' || o_custkey) < 20 THEN 'raw_description' END) AS faults FROM orders")
def canonical_queries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("requisition_id"), F.col("o_orderpriority").alias("role"), F.concat(F.lit("Order  of\ncustomer "), F.col("o_custkey").cast("string")).alias("job_description"), F.concat_ws(" | ", "o_orderstatus", "o_orderpriority").alias("must_haves"), F.when(F.col("o_custkey") % 2 == 0, " even ").otherwise("").alias("level"))
    c = tables.canonical_queries(o)
    return c.select("id", "title", "raw_description", F.array_join("must_have_skills", "|").alias("must"), "seniority", F.array_join(tables.query_faults(), ";").alias("faults"))


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '{\"k\":' || user_id || '}' WHEN user_id % 3 = 1 THEN '{\"raw\":\"' || user_id || ' x\"}' ELSE '{}' END AS object FROM (SELECT DISTINCT user_id FROM events)")
def open_objects(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    text = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('{"k":'), F.col("user_id").cast("string"), F.lit("}"))).when(F.col("user_id") % 3 == 1, F.concat(F.col("user_id").cast("string"), F.lit("  x")))
    return u.select("user_id", tables.open_object(text).alias("object"))


@query("SELECT p_partkey, trim('Skills: ' || array_to_string(string_split(p_type, ' '), ', ') || ' Recent roles: ' || p_brand || ' at ' || 'Firm ' || p_size || ' Summary: ' || p_name) AS text FROM part")
def entity_texts(spark, sf_dir):
    role = F.struct(F.col("p_brand").alias("title"), F.concat(F.lit("Firm "), F.col("p_size").cast("string")).alias("company"), F.lit("").alias("description"))
    return table(spark, sf_dir, "part").select("p_partkey", parse.entity_text(F.create_map(F.lit("summary"), "p_name"), F.split("p_type", " "), F.array(role)).alias("text"))


@query("SELECT p_partkey, 'Title: ' || p_name || ' Must have: ' || array_to_string(string_split(p_type, ' '), ', ') || ' Responsibilities: ' || p_brand || ' Description: ' || p_type AS text FROM part")
def query_texts(spark, sf_dir):
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "part").select("p_partkey", parse.query_text(F.col("p_name"), F.lit(None).cast("string"), F.split("p_type", " "), none, F.array("p_brand"), F.col("p_type")).alias("text"))


@query("SELECT p_partkey, array_to_string(string_split(p_type, ' '), '|') AS must FROM part")
def marked_skills(spark, sf_dir):
    text = F.concat(F.lit("We sell. Required skills: "), F.array_join(F.split("p_type", " "), ", "), F.lit(". More follows."))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parse.marked_skills(text, "required"), "|").alias("must"))


@query("SELECT user_id, 'Engineer' AS title, 'Acme ' || user_id AS company, (user_id % 40)::INT AS months FROM (SELECT DISTINCT user_id FROM events)")
def role_scan(spark, sf_dir):
    """A role with its range of dates, a bullet below it: one island of lines."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    start, end = F.lit("Jan 2015"), F.date_format(F.add_months(F.lit("2015-01-01").cast("date"), F.col("user_id").cast("int") % 40), "MMM yyyy")
    text = F.concat(F.lit("Engineer at Acme "), F.col("user_id").cast("string"), F.lit(", "), start, F.lit(" - "), end, F.lit("\n- Built things.\n"))
    found = parse.experience(u.withColumn("t", text), "user_id", "t", "2026-06-17")
    return found.select("user_id", F.explode("experience_entries").alias("e")).select("user_id", "e.title", "e.company", F.col("e.duration_months").alias("months"))


@query("""WITH tok AS (SELECT item_id, lower(unnest(regexp_extract_all('Represent this job description for retrieving matching candidates: ' || trim(text), '[A-Za-z0-9+#.]+'))) AS token FROM benchmark),
cells AS (SELECT item_id, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 64)::INT AS bucket, sum(CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS value FROM tok GROUP BY ALL HAVING value <> 0)
SELECT item_id, bucket, round(value / sqrt(sum(value * value) OVER (PARTITION BY item_id)), 6)::DOUBLE AS value FROM cells""")
def dense_embed(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    v = embed.dense(b, "item_id", embed.prepared(F.col("text"), embed.QUERY_PROMPT), 64)
    return v.select("item_id", F.posexplode("vector").alias("bucket", "value")).filter("value != 0").select("item_id", "bucket", r6(F.col("value").cast("double")).alias("value"))


# ---- features and metrics


@query("""SELECT o_orderkey, round((o_custkey % 7 / 7 + 1) / 2, 6)::DOUBLE AS dense, round(CASE WHEN o_custkey % 4 > 0 THEN 0.5 * least(1, (o_custkey % 50) / 24) + 0.5 * least(1, (o_custkey % 4) / 3) ELSE 0.5 END, 6)::DOUBLE AS travel,
round(coalesce((0.4 * (o_custkey % 3) / 3 + 0.3 * (o_custkey % 5) / 5 + 0.2 * (o_custkey % 7) / 7 + 0.1 * (o_custkey % 9) / 9) * 0.6 + 0.2, 0.5), 6)::DOUBLE AS behave,
round(CASE WHEN o_orderpriority LIKE '1%' AND o_custkey % 9 < 5 THEN (o_custkey % 9) / 5 ELSE 1 END, 6)::DOUBLE AS seniority, CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE round((o_custkey % 6) / 6, 6) END::DOUBLE AS confidence FROM orders""")
def pair_features(spark, sf_dir):
    k = F.col("o_custkey")
    part = lambda n: (k % n) / n
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", r6(score.dense_similarity(part(7))).alias("dense"), r6(score.trajectory((k % 50).cast("double"), k % 4)).alias("travel"), r6(score.behaviour(part(3), part(5), part(7), part(9), F.lit(0.6))).alias("behave"),
        r6(score.seniority((k % 9).cast("double"), F.when(F.col("o_orderpriority").startswith("1"), "senior").otherwise("junior"))).alias("seniority"), r6(explain.confidence(part(6))).alias("confidence"),
    )


@query(f"""WITH {catalog_records.RECORDS} SELECT d AS doc_id, round(0.4 * recency + 0.4 * (d % 2) + 0.2 * CASE WHEN notice < 30 THEN 1 WHEN notice <= 60 THEN 0.5 WHEN notice <= 90 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS availability, round(0.4 * (d % 11) / 10 + 0.3 / (1 + 2.0 / 24) + 0.3 * 0.5, 6)::DOUBLE AS engagement,
round(0.2 * (d % 3 <> 0)::INT + 0.2 * (d % 4 <> 0)::INT + 0.2 + 0.4 * least(1, (d % 9) / 3 / 5), 6)::DOUBLE AS trust, round(recency, 6)::DOUBLE AS recency, 0.6::DOUBLE AS confidence
FROM (SELECT *, exp(-ln(2.0::DOUBLE) / 90 * 16) AS recency FROM rec)""")
def activity_profiles(spark, sf_dir):
    p = behaviour.profiles(catalog_records.nested(table(spark, sf_dir, "documents").select("doc_id")), "signals", "doc_id")
    return p.select("doc_id", r6("availability_score").alias("availability"), r6("engagement_score").alias("engagement"), r6("trust_score").alias("trust"), r6("recency_score").alias("recency"), F.col("signal_confidence").alias("confidence"))


@query(f"WITH {catalog_records.RECORDS} SELECT 'accepted' AS name, count(*) AS n FROM rec WHERE {catalog_records._names(catalog_records.FAULTS_A)} = '' UNION ALL SELECT 'rejected', count(*) FROM rec WHERE {catalog_records._names(catalog_records.FAULTS_A)} <> ''")
def ingest_counts(spark, sf_dir):
    rows = catalog_records.nested(table(spark, sf_dir, "documents").select("doc_id"))
    good, bad = records.split_valid(rows, records.faults_a(), "documents", "candidate", "candidate_id", "doc_id")
    return ingest.counts({"accepted": good, "rejected": bad})


@query("SELECT round(avg((n_chars % 9 = 0)::INT), 6)::DOUBLE AS share FROM documents")
def flagged_share(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("flag", F.col("n_chars") % 9 == 0)
    return evaluate.flagged_share(d, "flag").select(r6("share").alias("share"))
