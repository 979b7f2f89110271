"""The first ranker: records to a top list for one fixed query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import flags
from rankloom.operators import explain, index, records, rules, score

#: The default query text: a parameter of every function here.
QUERY = "Senior AI Engineer Founding Team. We need someone with production experience building embeddings, retrieval, ranking, ann vector search, hybrid search, recommendation systems, evaluation frameworks ndcg mrr map a/b testing, python, machine learning, deep learning, natural language processing, large language models, RAG, vector databases, qdrant, pinecone, weaviate, scalable backend systems, search infrastructure, real time inference, model serving."


def scored(flat: DataFrame, query: str = QUERY) -> DataFrame:
    """Flat rows with bm25_norm, positives, negatives, flagged and score. Documents without a query term score 0 in BM25."""
    q = flat.sparkSession.createDataFrame([(0, query)], "q int, query string")
    found = index.bm25_a(flat.select("candidate_id", "all_text"), q, "candidate_id", "all_text", "q", "query").select("candidate_id", "score")
    with_bm25 = flat.join(found, "candidate_id", "left").withColumn("bm25", F.coalesce("score", F.lit(0.0))).drop("score")
    n = index.min_max(with_bm25, "bm25", out="bm25_norm")
    n = n.withColumns({"positives": flags(rules.positives_a()), "negatives": flags(rules.negatives_a()), "flagged": F.size(records.inconsistencies_a()) > 0})
    verified = F.coalesce(F.col("verified_email") & F.col("verified_phone"), F.lit(False))
    return n.withColumn("score", score.composite_a(F.col("bm25_norm"), F.size("positives") / len(rules.positives_a()), rules.notice_a(F.col("notice_period_days")), verified, rules.multiplier_a(F.col("negatives")), F.col("flagged")))


def ranked(flat: DataFrame, query: str = QUERY, top: int = 100) -> DataFrame:
    """candidate_id, rank, score, reasoning, flagged of the best `top` rows. The window sees only these."""
    best = scored(flat, query).orderBy(F.desc("score"), "candidate_id").limit(top)
    placed = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "candidate_id")))
    why = explain.reasoning_a(F.col("current_title"), F.col("years_of_experience"), F.col("positives"), F.col("negatives"), F.col("bm25_norm"), F.col("rank"))
    return placed.select("candidate_id", "rank", F.round("score", 6).alias("score"), why.alias("reasoning"), "flagged")


def from_records(raw: DataFrame, query: str = QUERY, top: int = 100, signals: str = "signals") -> tuple[DataFrame, DataFrame]:
    """(the top list, records that are not valid with their reasons)."""
    good, bad = records.split_valid(raw.withColumn("_row", F.monotonically_increasing_id()), records.faults_a(signals), "records", "candidate", "candidate_id", "_row")
    return ranked(records.flatten_a(good.drop("_row"), signals), query, top), bad
