"""Named queries of the stages between scans and results that the other catalogues leave out: stored tables, canonical constraints,
vectors, prompts, reranked lists and the metrics of a whole system, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import text as X
from rankloom.operators import embed, evaluate, explain, index, score, tables
from rankloom.operators.sizes import checkpointed
from rankloom.plans import second_ranker
from rankloom.plans.catalog_io import fresh
from rankloom.plans.store import Store
from rankloom.sources import readers, writers
from rankloom.sources.keyed import Keyed
from rankloom.streaming.totals import Totals

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col):
    return F.round(col, 6)


# ---- scans of stored tables


@query("""SELECT lpad(n::VARCHAR, 2, '0') AS part, row_number() OVER (PARTITION BY n ORDER BY c_custkey) - 1 + (row_number() OVER (PARTITION BY n ORDER BY c_custkey) - 1) // 7 AS row_index, c_custkey
FROM (SELECT c_nationkey AS n, c_custkey FROM customer)""")
def numbered_files_scan(spark, sf_dir):
    """Lines numbered within each of several files, a blank one after every seventh."""
    path, c = f"{fresh(spark)}/lines", table(spark, sf_dir, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("part"), "c_custkey")
    at = F.row_number().over(Window.partitionBy("part").orderBy("c_custkey"))
    line = F.concat(F.to_json(F.struct("c_custkey")), F.when(at % 7 == 0, "\n").otherwise(""))
    c.select("part", "c_custkey", line.alias("value")).repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "value").write.partitionBy("part").text(path)
    found = readers.numbered_lines(spark, path, T._parse_datatype_string("c_custkey long"), "file")
    return found.select(F.regexp_extract("file", "part=([0-9]+)", 1).alias("part"), "row_index", "c_custkey")


@query("SELECT s_name AS name, 'csv' AS kind FROM supplier UNION ALL SELECT n_name, 'parquet' FROM nation")
def parquet_else_csv_scan(spark, sf_dir):
    """A table that is there as CSV only, and one that is there in both forms with other rows in the CSV."""
    folder, s, n = fresh(spark), table(spark, sf_dir, "supplier").select("s_name"), table(spark, sf_dir, "nation").select("n_name")
    s.write.option("header", True).csv(f"{folder}/supplier.csv")
    s.toDF("n_name").write.option("header", True).csv(f"{folder}/nation.csv")
    n.write.parquet(f"{folder}/nation.parquet")
    a, b = (readers.parquet_or_csv(spark, f"{folder}/{x}") for x in ("supplier", "nation"))
    return a.select(F.col("s_name").alias("name"), F.lit("csv").alias("kind")).unionByName(b.select(F.col("n_name").alias("name"), F.lit("parquet").alias("kind")))


@query("SELECT c_custkey, c_name, true AS there FROM customer")
def typed_lines_or_none(spark, sf_dir):
    """A file of typed lines, and one that does not exist and gives no rows."""
    path, c = f"{fresh(spark)}/c.jsonl", table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    writers.json_lines(c, path)
    there, absent = (readers.json_lines_or_none(spark, p, c.schema) for p in (path, f"{path}.absent"))
    return there.withColumn("there", F.lit(True)).unionByName(absent.withColumn("there", F.lit(False)))


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey, rank FROM (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def stored_results_scan(spark, sf_dir):
    """Results of all priorities are stored by query; those of one are read, a partition."""
    store, o = Store(spark, fresh(spark)), table(spark, sf_dir, "orders")
    ranked = o.select(F.col("o_orderpriority").alias("job_id"), F.col("o_orderkey").cast("string").alias("id"), "o_custkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rank"))
    writers.replace_results(ranked, store.path("rankings"))
    return store.results(o.agg(F.min("o_orderpriority")).first()[0]).select("id", "o_custkey", "rank")


@query("SELECT s_suppkey::VARCHAR AS id, s_name FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier)")
def stored_lookup(spark, sf_dir):
    """A table is saved whole, and one row of it is read back by its key."""
    store, s = Store(spark, fresh(spark)), table(spark, sf_dir, "supplier")
    store.save("candidates", s.select(F.col("s_suppkey").cast("string").alias("id"), "s_name"))
    return store.one("candidates", str(s.agg(F.max("s_suppkey")).first()[0]))


# ---- canonical constraints

_FAULTS = "concat_ws('|', {0})"


@query(f"""SELECT 'entity' AS kind, faults, count(*) AS n FROM (SELECT {_FAULTS.format("CASE WHEN id = '' THEN 'id' END, CASE WHEN t = '' THEN 'raw_resume_text' END, CASE WHEN y < 0 THEN 'experience_years' END, CASE WHEN NOT regexp_matches(u, '^https?://[^/ ]+') THEN 'github_url' END")} AS faults
  FROM (SELECT CASE WHEN lang = 'en' THEN '' ELSE doc_id::VARCHAR END AS id, CASE WHEN n_chars > 400 THEN coalesce(text, '') ELSE '' END AS t, (n_chars - 800) / 200 AS y, CASE WHEN source = 'src1' THEN source WHEN source = 'src2' THEN NULL ELSE 'https://' || source END AS u FROM documents)) GROUP BY ALL
UNION ALL SELECT 'query', faults, count(*) FROM (SELECT {_FAULTS.format("CASE WHEN item_id % 2 = 0 THEN 'id' END, CASE WHEN length(text) < 200 THEN 'title' END, CASE WHEN length(left(text, item_id::INT)) < 20 THEN 'raw_description' END")} AS faults FROM benchmark) GROUP BY ALL""")
def canonical_constraints(spark, sf_dir):
    """Rows that break the constraints of canonical entities and queries, by what they break."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    url = F.when(F.col("source") == "src1", F.col("source")).when(F.col("source") == "src2", F.lit(None)).otherwise(F.concat(F.lit("https://"), "source"))
    e = d.select(F.when(F.col("lang") == "en", "").otherwise(F.col("doc_id").cast("string")).alias("id"), F.when(F.col("n_chars") > 400, F.coalesce("text", F.lit(""))).otherwise("").alias("raw_resume_text"), ((F.col("n_chars") - 800) / 200).alias("experience_years"), url.alias("github_url"))
    q = b.select(F.when(F.col("item_id") % 2 == 0, "").otherwise(F.col("item_id").cast("string")).alias("id"), F.when(F.char_length("text") < 200, "").otherwise(F.col("text")).alias("title"), F.substring("text", F.lit(1), F.col("item_id").cast("int")).alias("raw_description"))
    count = lambda df, kind, faults: df.groupBy(F.array_join(faults, "|").alias("faults")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "faults", "n")
    return count(e, "entity", tables.entity_faults()).unionByName(count(q, "query", tables.query_faults()))


# ---- vectors and prompts


@query("SELECT vec_id, i, round((CASE WHEN size > 0 THEN x / size ELSE x END)::FLOAT::DOUBLE, 5) + 0 AS value FROM (SELECT vec_id, unnest(range(1, 81)) AS i, coalesce(embedding[unnest(range(1, 81))]::DOUBLE, 0) AS x, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS size FROM embeddings) UNION ALL SELECT vec_id, -i, round((CASE WHEN size > 0 THEN x / size ELSE x END)::FLOAT::DOUBLE, 5) + 0 FROM (SELECT vec_id, unnest(range(1, 33)) AS i, embedding[unnest(range(1, 33))]::DOUBLE AS x, sqrt(list_sum(list_transform(embedding[1:32], lambda y: y::DOUBLE * y::DOUBLE))) AS size FROM embeddings)")
def fitted_vectors(spark, sf_dir):
    """Vectors padded to 80 dimensions, and cut to 32 (places below 0), then of length 1."""
    e = table(spark, sf_dir, "embeddings")
    out = [e.select("vec_id", F.posexplode(embed.fitted(F.col("embedding"), n)).alias("i", "x")).select("vec_id", ((F.col("i") + 1) * sign).cast("long").alias("i"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("value")) for n, sign in ((80, 1), (32, -1))]
    return out[0].unionByName(out[1])


@query("SELECT a.vec_id, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", r6(X.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("""SELECT doc_id, md5('Explain why this candidate matches the role. Use only these facts. Answer with JSON of the shape {"matched_points": [string], "missing_points": [string], "confidence": number, "narrative": string}' || chr(10) || 'Facts: {"candidate_id":"' || doc_id || '","skills":["' || lang || '"],"rank":' || n_chars || '}') AS prompt_md5 FROM documents""")
def prompts(spark, sf_dir):
    facts = F.struct(F.col("doc_id").cast("string").alias("candidate_id"), F.array("lang").alias("skills"), F.col("n_chars").alias("rank"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(explain.prompt(facts)).alias("prompt_md5"))


# ---- reranked lists and the metrics of a system


@query("""WITH r AS (SELECT o_custkey AS job_id, o_orderkey AS id, round(o_totalprice / 500000, 9)::DOUBLE AS composite, o_orderkey % 97 / 97 AS model, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY composite DESC, place) AS original_rank FROM r),
f AS (SELECT *, round(0.3::DOUBLE * (1 / (1 + exp(-(4 * model - 2)))) + 0.7::DOUBLE * composite, 9) AS final_score FROM o)
SELECT job_id, id, original_rank, rank, round(final_score, 6) AS final_score, original_rank - rank AS moved FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, original_rank) AS rank FROM f) WHERE rank <= 5""")
def reranked_lists(spark, sf_dir):
    """Lists by composite, blended with a model's logits (of the order's number, here), cut to five; what each row gained."""
    o, at = table(spark, sf_dir, "orders"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice").cast("double") / 500000, 9).alias("composite"), F.row_number().over(at).alias("place"))
    logit = 4 * (F.col("id") % 97 / 97) - 2
    found = second_ranker.reranked(rows, score.sigmoid(logit), 0.3, 5)
    return found.select("job_id", "id", F.col("original_rank").cast("long").alias("original_rank"), F.col("rank").cast("long").alias("rank"), r6(F.round("final_score", 9)).alias("final_score"), (F.col("original_rank") - F.col("rank")).cast("long").alias("moved"))


@query(None)
def second_ranking(spark, sf_dir):
    """The whole second ranker: documents as entities, benchmark items as jobs; the first three of each."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    entities = d.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("raw_resume_text"), F.array("lang", "source").alias("skills_raw"), (F.col("n_chars") / 200).alias("experience_years"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("github_url"))
    jobs = b.select(F.col("item_id").cast("string").alias("id"), F.lit("Reader").alias("title"), F.col("text").alias("raw_description"), F.array(F.lit("en")).alias("must_have_skills"), F.array(F.lit("src1")).alias("nice_to_have_skills"), F.lit(None).cast("string").alias("seniority"), F.lit(None).cast("string").alias("location"))
    found = second_ranker.rank(entities, jobs, top=3)
    return found.select("job_id", "candidate_id", "rank", "original_rank", r6("final_score").alias("final_score"), F.array_join("tags", "|").alias("tags"))


def system_metrics(spark, sf_dir):
    """One row: the means of the metrics over all judged queries, of the rankings that the per-query metrics judge."""
    from rankloom.plans import catalog

    ranked, judgments, _ = catalog.judged(spark, sf_dir)
    found = evaluate.summary(ranked, judgments, "item_id", "doc_id")
    return found.select(*[r6(c).alias(c) for c in ("ndcg_10", "ndcg_50", "average_precision", "precision_5", "mrr", "composite")])


def baseline_against_system(spark, sf_dir):
    """The keyword baseline against BM25 over the same judgments, as the compare command does it."""
    from rankloom.plans import catalog

    ranked, judgments, _ = catalog.judged(spark, sf_dir)
    base = index.keyword_lists(catalog.documents(spark, sf_dir), catalog.items(spark, sf_dir), "doc_id", "text", "item_id", "q_text", 50)
    base = checkpointed(index.top_k(base, 50, "item_id", [F.desc("overlap"), F.asc("doc_id")]).select("item_id", "doc_id", "rank"))
    out = evaluate.compared(base, ranked, judgments, "item_id", "doc_id")
    return out.select("metric_name", *[r6(c).alias(c) for c in ("baseline_score", "system_score", "delta")])


# ---- tables laid out by key


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey < 5 THEN 'new' ELSE s_name END AS name, CASE WHEN s_nationkey < 5 THEN s_nationkey END AS more FROM supplier UNION ALL SELECT s_suppkey + 1000000000, 'added', NULL FROM supplier WHERE s_nationkey >= 20")
def keyed_changes(spark, sf_dir):
    """A table in three changes: all suppliers, new names and a new column for some, and rows that were not there."""
    stored, s = Keyed(spark, f"{fresh(spark)}/suppliers"), table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("long").alias("id")
    stored.upsert(s.select(key, F.col("s_name").alias("name")))
    stored.upsert(s.filter("s_nationkey < 5").select(key, F.lit("new").alias("name"), F.col("s_nationkey").alias("more")))
    stored.upsert(s.filter("s_nationkey >= 20").select((F.col("s_suppkey") + 1000000000).cast("long").alias("id"), F.lit("added").alias("name")))
    return stored.rows()


_SCALED = "(({0} - min({0}) OVER ()) / nullif(max({0}) OVER () - min({0}) OVER (), 0))"


@query(f"""WITH a AS (SELECT user_id, sum(coalesce(value, 1)) AS frequency, exp(-ln(2.0::DOUBLE) / 90 * greatest(date_diff('day', max(ts)::DATE, DATE '2024-01-31'), 0)) AS recency FROM events GROUP BY user_id)
SELECT user_id, round(coalesce({_SCALED.format('frequency')}, 0.5), 6)::DOUBLE AS frequency, round(coalesce({_SCALED.format('recency')}, 0.5), 6)::DOUBLE AS recency FROM a""")
def population_from_totals(spark, sf_dir):
    """population_minmax from totals that grow by the events of a week at a time; the second week is given twice."""
    totals, e = Totals(spark, f"{fresh(spark)}/totals", 8), table(spark, sf_dir, "events")
    week = F.weekofyear(F.col("ts").cast("timestamp"))
    weeks = sorted(r[0] for r in e.select(week).distinct().collect())
    for w in [*weeks[:2], *weeks[1:]]:
        totals.add(e.filter(week == w), f"week {w}")
    return totals.scaled("2024-01-31").select("user_id", r6("frequency").alias("frequency"), r6("recency").alias("recency"))
