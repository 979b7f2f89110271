"""Skill vocabulary and property graph: normal names, edges, distances, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import vocab as V
from rankloom.operators import similar
from rankloom.operators.sizes import checkpointed, small

FUZZY = 88.0
#: Rows of a node above which its joins are cut.
HUB = 4096


def canonical(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(F.lower(F.btrim(text)), "_-", "  "), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.replace(F.lower(F.btrim(text)), F.lit(" "), F.lit("_"))


def aliases(spark: SparkSession, names: dict[str, list[str]] | None = None) -> DataFrame:
    """alias, skill: each skill's own name among its aliases."""
    names = V.ALIASES if names is None else names
    rows = sorted({(a, k) for k, values in names.items() for a in [k, *values]})
    return spark.createDataFrame(rows, "alias string, skill string")


def normalised(skills: DataFrame, column: str, names: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """column and skill for each distinct value: by exact alias, else by the most similar one that reaches the threshold (the first
    by its characters among equals), else itself. names: alias, skill; of several skills of an alias the first counts.

    Values and aliases meet in equality joins (similar.similar_names); only distinct values without an exact alias take part."""
    one = names.groupBy("alias").agg(F.min("skill").alias("skill"))
    distinct = checkpointed(skills.select(F.col(column)).distinct().withColumn("_c", canonical(F.col(column))).join(one, F.col("_c") == F.col("alias"), "left").drop("alias"))
    open_ = distinct.filter("skill is null and _c != ''").select(F.col("_c").alias("name")).distinct()
    near = similar.best_names(open_, one.select(F.col("alias").alias("other")).filter("alias is not null"), threshold)
    found = near.join(one.select(F.col("alias").alias("other"), F.col("skill").alias("_near")), "other").select(F.col("name").alias("_c"), "_near")
    return distinct.join(found, "_c", "left").select(column, F.coalesce("skill", "_near", "_c").alias("skill"))


def grown(rows: DataFrame, raw: str, at: str, names: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """alias and skill: the vocabulary `names` after all values of `raw` in the order of `at` (distinct places). A value that is no alias yet
    becomes one: of the skill of the most similar alias before it that reaches the threshold, be that a given one or an
    earlier value, or else of a new skill, itself.

    So a value hangs on the most similar of what comes before it, whatever that hangs on, and a similarity join finds it for all values at once. What
    remains is to follow each value up to a given alias or a new skill: pointers are doubled, a written round each, so rounds are the
    logarithm of the longest chain."""
    first = rows.groupBy(canonical(F.col(raw)).alias("name")).agg(F.min(at).alias("at")).filter("name != ''")
    one = checkpointed(names.filter("alias is not null").groupBy("alias").agg(F.min("skill").alias("skill")))
    values = checkpointed(first.join(one.select(F.col("alias").alias("name")), "name", "left_anti"))
    before = one.select(F.col("alias").alias("other"), F.lit(None).cast(values.schema["at"].dataType).alias("other_at")).unionByName(values.select(F.col("name").alias("other"), F.col("at").alias("other_at")))
    near = similar.similar_names(values.select("name"), before.select("other"), threshold).join(values, "name").join(before, "other").filter("other_at is null or other_at < at")
    up = near.groupBy("name").agg(F.min_by("other", F.struct((-F.col("score")).alias("s"), "other")).alias("up"))
    hung = checkpointed(values.join(up, "name", "left").select("name", "up"))
    known = one.unionByName(hung.filter("up is null").select(F.col("name").alias("alias"), F.col("name").alias("skill")))
    open_ = hung.filter("up is not null")
    while not open_.isEmpty():
        step = checkpointed(open_.join(known.select(F.col("alias").alias("up"), "skill"), "up", "left"))
        known = checkpointed(known.unionByName(step.filter("skill is not null").select(F.col("name").alias("alias"), "skill")))
        open_ = checkpointed(step.filter("skill is null").select("name", "up").join(open_.select(F.col("name").alias("up"), F.col("up").alias("next")), "up").select("name", F.col("next").alias("up")))
    return known


def implied(spark: SparkSession, names: DataFrame, implications: dict[str, list[str]] | None = None) -> DataFrame:
    """src, dst: implications between normal names, each once; names that mean the same give an edge to itself."""
    implications = V.IMPLIES if implications is None else implications
    pairs = spark.createDataFrame(sorted((a, b) for a, bs in implications.items() for b in bs), "a string, b string")
    n = names.select("alias", "skill")
    left = pairs.join(n.select(F.col("alias").alias("a"), F.col("skill").alias("sa")), "a", "left").join(n.select(F.col("alias").alias("b"), F.col("skill").alias("sb")), "b", "left")
    return left.select(F.coalesce("sa", "a").alias("src"), F.coalesce("sb", "b").alias("dst")).distinct()


def role_edges(roles: DataFrame, entity: str, index: str, title: str, company: str) -> DataFrame:
    """src, dst, kind, weight: entity to role, role to company, role to the next role in the order of index."""
    key = F.concat(F.lit("role:"), F.col(entity).cast("string"), F.lit(":"), F.col(index).cast("string"), F.lit(":"), slug(F.col(title)))
    r = roles.select(F.concat(F.lit("candidate:"), F.col(entity).cast("string")).alias("who"), key.alias("role"), F.when(F.btrim(company) != "", F.concat(F.lit("company:"), slug(F.col(company)))).alias("at"), F.col(index).alias("i"))
    r = r.withColumn("before", F.lag("role").over(Window.partitionBy("who").orderBy("i")))
    # One pass over the roles makes all three kinds.
    some = F.array(F.struct(F.col("who").alias("src"), F.col("role").alias("dst"), F.lit("WORKED_AS").alias("kind")), F.struct(F.col("role").alias("src"), F.col("at").alias("dst"), F.lit("AT_COMPANY").alias("kind")), F.struct(F.col("before").alias("src"), F.col("role").alias("dst"), F.lit("TRANSITIONED_TO").alias("kind")))
    return r.select(F.explode(some).alias("e")).select("e.*").filter("src is not null and dst is not null").withColumn("weight", F.lit(1.0))


def skill_edges(rows: DataFrame, entity: str, skill: str) -> DataFrame:
    return rows.filter(F.btrim(skill) != "").select(F.concat(F.lit("candidate:"), F.col(entity).cast("string")).alias("src"), F.concat(F.lit("skill:"), F.col(skill)).alias("dst"), F.lit("HAS_SKILL").alias("kind"), F.lit(1.0).alias("weight")).distinct()


def wanted_edges(rows: DataFrame, query: str, skill: str, preferred: str) -> DataFrame:
    """Required skills weigh 1, preferred ones 0.5; a skill that is both is preferred."""
    best = rows.groupBy(query, skill).agg(F.max(preferred).alias("p"))
    return best.select(F.concat(F.lit("job:"), F.col(query).cast("string")).alias("src"), F.concat(F.lit("skill:"), F.col(skill)).alias("dst"), F.when(F.col("p"), "PREFERS_SKILL").otherwise("REQUIRES_SKILL").alias("kind"), F.when(F.col("p"), 0.5).otherwise(1.0).alias("weight"))


def met_at(left: DataFrame, right: DataFrame, node: str, most: int = HUB) -> DataFrame:
    """left and right joined on a node. Where a node has more than `most` rows on a side, both sides are cut there into pieces of about
    that many rows, and each piece meets each of the other side's, in a task of its own."""
    many = lambda df, n: df.groupBy(node).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(n))
    hubs = checkpointed(many(left, "_l").join(many(right, "_r"), node).filter("_l > 1 or _r > 1"))
    if hubs.isEmpty():
        return left.join(right, node)
    hubs, tasks = small(hubs), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        n = lambda c: F.coalesce(F.col(c), F.lit(1))
        piece = F.pmod(F.xxhash64(*df.columns), n(own)).cast("int")
        return df.join(hubs, node, "left").withColumn("_own", piece).withColumn("_other", F.explode(F.sequence(F.lit(0), n(other) - 1))).select(*df.columns, F.col("_own").alias(own), F.col("_other").alias(other))

    # Pieces are few bytes and many pairs, so a number of tasks is given: sizes would put all pieces in one.
    pieces = [cut(*side).repartition(tasks, node, "_l", "_r") for side in ((left, "_l", "_r"), (right, "_r", "_l"))]
    return pieces[0].join(pieces[1], [node, "_l", "_r"]).drop("_l", "_r")


def reached(both: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """start, node and d: all nodes up to `steps` edges away. A step's new nodes are the next one's frontier; every step is written."""
    found = frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("d")).distinct()
    for d in range(1, steps + 1):
        next_ = met_at(frontier.select("start", "node"), both, "node").select("start", F.col("to").alias("node")).distinct()
        frontier = checkpointed(next_.join(found, ["start", "node"], "left_anti").withColumn("d", F.lit(d)))
        found = found.unionByName(frontier)
    return found


def distances(edges: DataFrame, sources: DataFrame, targets: DataFrame, cutoff: int = 2) -> DataFrame:
    """src, dst, distance between the given nodes in the undirected graph, up to `cutoff`; pairs farther apart are absent.
    Where absent pairs count 3, as in closeness, a cutoff of 2 says the same as one of 3 and costs a step less.

    Both ends are expanded, half of the cutoff each, and meet in the middle, so no path is followed to its end from one side; nodes with many
    edges are cut into pieces, so no task makes all pairs of one. An odd step is taken from the end with fewer nodes: from the other, nodes
    that share a hub would all meet each other there."""
    sources, targets = (checkpointed(x.select("node").distinct()) for x in (sources, targets))
    halves = (cutoff - cutoff // 2, cutoff // 2) if sources.count() <= targets.count() else (cutoff // 2, cutoff - cutoff // 2)
    both = checkpointed(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))).filter("node != to").distinct())
    from_ = reached(both, sources, halves[0]).select(F.col("start").alias("src"), "node", F.col("d").alias("d_src"))
    to = reached(both, targets, halves[1]).select(F.col("start").alias("dst"), "node", F.col("d").alias("d_dst"))
    return met_at(from_, to, "node").groupBy("src", "dst").agg(F.min(F.col("d_src") + F.col("d_dst")).alias("distance"))


def trajectories(roles: DataFrame, skills: DataFrame, entity: str, months: str, company: str, skill: str) -> DataFrame:
    """entity, role_count, company_count, avg_role_duration_months, skill_count."""
    r = roles.groupBy(entity).agg(F.count(F.lit(1)).alias("role_count"), F.count_distinct(F.nullif(F.col(company).cast("string"), F.lit(""))).alias("company_count"), F.coalesce(F.avg(months), F.lit(0.0)).alias("avg_role_duration_months"))
    s = skills.groupBy(entity).agg(F.count_distinct(skill).alias("skill_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.join(s, entity, "full_outer").select(entity, zero("role_count"), zero("company_count"), F.coalesce("avg_role_duration_months", F.lit(0.0)).alias("avg_role_duration_months"), zero("skill_count"))


def counts(edges: DataFrame) -> DataFrame:
    """One row: nodes and edges of a graph of edges (src, dst)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.agg(F.count_distinct("node").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges"))
