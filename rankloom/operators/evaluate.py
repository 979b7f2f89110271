"""Ranking metrics against judgments, as joins and grouped sums; and a check of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import flags


def judged(ranking: DataFrame, judgments: DataFrame, query: str, doc: str) -> DataFrame:
    """The ranking with rel: 0 where nobody judged; the last judgment of a pair holds."""
    return ranking.join(judgments.select(query, doc, "rel"), [query, doc], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def precision_at(rows: DataFrame, query: str, k: int, relevant: int = 1) -> DataFrame:
    """Hits among the first k, over k itself."""
    return rows.groupBy(query).agg((F.count_if((F.col("rank") <= k) & (F.col("rel") >= relevant)) / max(k, 1)).alias("value"))


def reciprocal_rank(rows: DataFrame, query: str, relevant: int = 1) -> DataFrame:
    return rows.groupBy(query).agg(F.coalesce(1 / F.min(F.when(F.col("rel") >= relevant, F.col("rank"))), F.lit(0.0)).alias("value"))


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1.0)


def ndcg_at(rows: DataFrame, judgments: DataFrame, query: str, k: int) -> DataFrame:
    """Discounted gain of the first k over that of the best order of all judged documents; 0 where that is 0."""
    dcg = rows.filter(F.col("rank") <= k).groupBy(query).agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    best = judgments.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rel")))).filter(F.col("place") <= k)
    ideal = best.groupBy(query).agg(F.sum(gain(F.col("rel"), F.col("place"))).alias("ideal"))
    return ideal.join(dcg, query, "left").select(query, F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("value"))


def average_precision(rows: DataFrame, judgments: DataFrame, query: str, relevant: int = 1) -> DataFrame:
    """Mean of the precision at each relevant rank, over all relevant documents."""
    seen = rows.withColumn("hits", F.sum((F.col("rel") >= relevant).cast("int")).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    total = judgments.groupBy(query).agg(F.count_if(F.col("rel") >= relevant).alias("n"))
    summed = seen.groupBy(query).agg(F.sum(F.when(F.col("rel") >= relevant, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("s"))
    return total.join(summed, query, "left").select(query, F.when(F.col("n") > 0, F.coalesce("s", F.lit(0.0)) / F.col("n")).otherwise(0.0).alias("value"))


#: Parts of the composite metric.
COMPOSITE = {"ndcg_10": 0.50, "ndcg_50": 0.30, "average_precision": 0.15, "precision_5": 0.05}


def per_query(rows: DataFrame, judgments: DataFrame, query: str, doc: str) -> DataFrame:
    """query, the parts of the composite metric and composite, of every judged query; one without results has 0."""
    j = judged(rows, judgments, query, doc)
    out = judgments.select(query).distinct()
    parts = {"ndcg_10": ndcg_at(j, judgments, query, 10), "ndcg_50": ndcg_at(j, judgments, query, 50), "average_precision": average_precision(j, judgments, query), "precision_5": precision_at(j, query, 5), "mrr": reciprocal_rank(j, query)}
    for name, metric in parts.items():
        out = out.join(metric.select(query, F.col("value").alias(name)), query, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out.withColumn("composite", sum([F.col(k) * w for k, w in COMPOSITE.items()], F.lit(0.0)))


def summary(rows: DataFrame, judgments: DataFrame, query: str, doc: str) -> DataFrame:
    """One row: the means of per_query over all judged queries."""
    found = per_query(rows, judgments, query, doc)
    return found.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in found.columns if c != query])


def compared(baseline: DataFrame, system: DataFrame, judgments: DataFrame, query: str, doc: str, k: int = 5) -> DataFrame:
    """metric_name, baseline_score, system_score, delta: means over the judged queries; a query without results counts 0."""
    asked = judgments.select(query).distinct()
    out = None
    for name, metric in ((f"Precision@{k}", lambda r: precision_at(r, query, k)), ("MRR", lambda r: reciprocal_rank(r, query)), (f"NDCG@{k}", lambda r: ndcg_at(r, judgments, query, k))):
        two = [asked.join(metric(judged(r, judgments, query, doc)), query, "left").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias(side)) for r, side in ((baseline, "baseline_score"), (system, "system_score"))]
        row = two[0].crossJoin(two[1]).select(F.lit(name).alias("metric_name"), "baseline_score", "system_score", (F.col("system_score") - F.col("baseline_score")).alias("delta"))
        out = row if out is None else out.unionByName(row)
    return out


def result_faults(result: DataFrame, size: int = 100, id_pattern: str = "^CAND_[0-9]{7}$") -> DataFrame:
    """fault and n: what is wrong with a result table of (candidate_id, rank, score, reasoning), all as text; none if it is valid."""
    number = F.col("rank").rlike("^[1-9][0-9]*$")
    rows = result.withColumns({"r": F.when(number, F.col("rank").try_cast("int")), "s": F.col("score").try_cast("double")})
    each = rows.select(F.explode(flags({"candidate_id": ~F.coalesce(F.col("candidate_id").rlike(id_pattern), F.lit(False)), "rank": ~F.coalesce(F.col("r").between(1, size), F.lit(False)), "score": F.col("s").isNull()})).alias("fault"))
    # A result is a top list of a stated size, so one window over it is a bounded task.
    before = Window.orderBy("r")
    order = rows.filter("r is not null").withColumns({"s0": F.lag("s").over(before), "c0": F.lag("candidate_id").over(before)}).select(F.explode(flags({"score increases": F.col("s") > F.col("s0"), "tie order": (F.col("s") == F.col("s0")) & (F.col("candidate_id") < F.col("c0"))})).alias("fault"))
    twice = lambda c: rows.groupBy(c).count().filter("count > 1").select(F.lit(f"repeated {c}").alias("fault"))
    count = rows.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != size).select(F.lit("number of rows").alias("fault"))
    want = rows.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("r")).join(rows.select("r"), "r", "left_anti").select(F.lit("missing rank").alias("fault"))
    return each.unionByName(order).unionByName(twice("candidate_id")).unionByName(twice("rank")).unionByName(count).unionByName(want).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def flagged_share(ranking: DataFrame, flag: str) -> DataFrame:
    return ranking.agg(F.avg(F.col(flag).cast("int")).alias("share"))
