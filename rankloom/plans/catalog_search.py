"""Named queries of the stored text index, of similar names and of graph distances, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import graph, similar, text_store
from rankloom.operators.sizes import shared_folder

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stored text index


def stored(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    path = f"{shared_folder(spark)}/rankloom/index-{uuid.uuid4().hex}"
    text_store.write(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", path, form)
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q_text"))
    found = text_store.Store(spark, path).search(asked, "item_id", "q_text", 20)
    return found.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


def stored_index_topk(spark, sf_dir):
    """The lists of bm25_topk, from an index that is written first."""
    return stored(spark, sf_dir, "a")


def stored_index_okapi(spark, sf_dir):
    """The lists of bm25_okapi_all_queries, from an index that is written first."""
    return stored(spark, sf_dir, "b")


# ---- similar names

#: The strings that lack one character of another. Among names of at most 12 characters a ratio of 88 means two indels at the most, so such
#: strings decide; what has more is given a ratio of 0.
LESS = "list_transform(range(1, len({0}) + 1), lambda i: {0}[1:i - 1] || {0}[i + 1:])"


def _indels(a: str, b: str) -> str:
    one, two = LESS.format(a), LESS.format(b)
    within = lambda x, y, less: f"list_contains(flatten(list_transform({less}, lambda z: {LESS.format('z')})), {y})"
    return f"CASE WHEN {a} = {b} THEN 0 WHEN len({a}) = len({b}) + 1 AND list_contains({one}, {b}) OR len({b}) = len({a}) + 1 AND list_contains({two}, {a}) THEN 1 WHEN len({a}) = len({b}) AND list_has_any({one}, {two}) OR len({a}) = len({b}) + 2 AND {within(a, b, one)} OR len({b}) = len({a}) + 2 AND {within(b, a, two)} THEN 2 ELSE 99 END"


def _ratio(a: str, b: str) -> str:
    return f"greatest(0, 100.0::DOUBLE * (len({a}) + len({b}) - ({_indels(a, b)})) / (len({a}) + len({b})))"


def _similar(names: str, known: str) -> str:
    """CTEs that end in near (name, other, score): pairs of names (name) and known (other) that reach 88."""
    rest = lambda t: f"array_to_string(list_concat(both_, list_sort(list_filter({t}, lambda x: NOT list_contains(both_, x)))), ' ')"
    return f"""
forms AS (SELECT name AS s, list_sort(string_split(name, ' ')) AS t FROM (SELECT name FROM {names} UNION SELECT other FROM {known})),
pairs AS (SELECT name, other, a.t AS ta, b.t AS tb, list_sort(list_intersect(a.t, b.t)) AS both_, array_to_string(a.t, ' ') AS sa, array_to_string(b.t, ' ') AS sb
  FROM {names} JOIN {known} ON abs(len(name) - len(other)) <= 2 OR list_has_any(string_split(name, ' '), string_split(other, ' ')) JOIN forms a ON a.s = name JOIN forms b ON b.s = other),
tails AS (SELECT *, {rest('ta')} AS wa, {rest('tb')} AS wb FROM pairs),
near AS (SELECT * FROM (SELECT name, other, greatest({_ratio('name', 'other')}, 0.95::DOUBLE * {_ratio('sa', 'sb')},
  0.95::DOUBLE * CASE WHEN len(both_) > 0 AND (len(both_) = len(list_distinct(ta)) OR len(both_) = len(list_distinct(tb))) THEN 100 ELSE {_ratio('wa', 'wb')} END) AS score FROM tails WHERE name <> '' AND other <> '') WHERE score >= 88)"""


#: A part's name without one of its characters, by its key.
TYPO = "left(p_name, (p_partkey % len(p_name))::INT) || substr(p_name, (p_partkey % len(p_name))::INT + 2)"


def typos(spark, sf_dir) -> DataFrame:
    at = (F.col("p_partkey") % F.char_length("p_name")).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.substring("p_name", F.lit(1), at), F.substring("p_name", at + 2, F.lit(100))).alias("raw"))


@query(f"""WITH raw AS (SELECT DISTINCT {TYPO} AS raw FROM part), v AS (SELECT DISTINCT trim(regexp_replace(raw, ' +', ' ', 'g')) AS name FROM raw), k AS (SELECT DISTINCT p_name AS other FROM part), open_ AS (SELECT name FROM v WHERE name NOT IN (FROM k)),{_similar('open_', 'k')},
best AS (SELECT name, arg_min(other, (-score, other)) AS other FROM near GROUP BY name)
SELECT raw, coalesce(k.other, best.other, c) AS skill FROM (SELECT raw, trim(regexp_replace(raw, ' +', ' ', 'g')) AS c FROM raw) LEFT JOIN k ON k.other = c LEFT JOIN best ON best.name = c""")
def fuzzy_skill_names(spark, sf_dir):
    """Names of all parts, each without one character, to the most similar whole names."""
    t = typos(spark, sf_dir)
    names = t.select(F.col("p_name").alias("alias"), F.col("p_name").alias("skill")).distinct()
    return graph.normalised(t.select("raw"), "raw", names)


@query(f"""WITH RECURSIVE v AS (SELECT trim(regexp_replace({TYPO}, ' +', ' ', 'g')) AS name, min(p_partkey) AS at FROM part GROUP BY 1), n AS (SELECT name FROM v), k AS (SELECT name AS other FROM v),{_similar('n', 'k')},
up AS (SELECT name, arg_min(other, (-score, other)) AS up FROM near JOIN v a USING (name) JOIN v b ON b.name = other WHERE b.at < a.at GROUP BY name),
root AS (SELECT name AS alias, name AS skill FROM v WHERE name NOT IN (SELECT name FROM up) UNION ALL SELECT up.name, root.skill FROM root JOIN up ON up.up = root.alias)
SELECT alias, skill FROM root""")
def vocabulary_growth(spark, sf_dir):
    """A vocabulary that starts empty and takes the names of all parts, each without one character, in the order of their keys."""
    return graph.grown(typos(spark, sf_dir), "raw", "p_partkey", spark.createDataFrame([], "alias string, skill string"))


# ---- distances


@query("""WITH e AS (SELECT 'candidate:' || c_custkey AS a, 'skill:' || n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'job:' || s_suppkey, 'skill:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'skill:' || n_name, 'skill:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), one AS (SELECT a AS src, b AS dst FROM both_ WHERE a LIKE 'candidate:%'),
two AS (SELECT DISTINCT src, b AS dst FROM one JOIN both_ ON dst = a), three AS (SELECT DISTINCT src, b AS dst FROM two JOIN both_ ON dst = a WHERE b LIKE 'skill:%'),
d AS (SELECT src, dst, 1 AS d FROM one UNION ALL SELECT src, dst, 2 FROM two WHERE dst LIKE 'skill:%' UNION ALL SELECT src, dst, 3 FROM three)
SELECT src, dst, min(d)::INT AS distance FROM d WHERE dst LIKE 'skill:%' GROUP BY ALL""")
def implied_distance(spark, sf_dir):
    """Up to three edges from every candidate to every skill, over held, required and implied skills: customers hold their nation, suppliers
    require theirs, nations imply their region. A nation has thousands of edges."""
    n, r, c, s = (table(spark, sf_dir, t) for t in ("nation", "region", "customer", "supplier"))
    skill = lambda x: F.concat(F.lit("skill:"), x)
    held = graph.skill_edges(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), "c_custkey", "n_name")
    wanted = graph.wanted_edges(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("preferred", F.lit(False)), "s_suppkey", "n_name", "preferred")
    implied = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(skill("n_name").alias("src"), skill("r_name").alias("dst"))
    edges = held.select("src", "dst").unionByName(wanted.select("src", "dst")).unionByName(implied)
    skills = n.select(skill("n_name").alias("node")).unionByName(r.select(skill("r_name").alias("node")))
    return graph.distances(edges, held.select(F.col("src").alias("node")), skills, 3)


# ---- near pairs


@query(None)
def near_text_counts(spark, sf_dir):
    """Of every different text of documents, by the least id that has it: how many other texts reach a token-set ratio of 99."""
    texts = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", similar.text_class(F.col("text")).alias("c"), "text")
    found = similar.near_pairs(texts, "c", "text").select(F.explode(F.array("x", "y")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("c").agg(F.min("doc_id").alias("doc_id")).join(found, "c", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))
