"""Features of a query-entity pair, weighted scores that skip missing features, penalties, reranking and blending."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.operators.filters import expected_years

WEIGHTS = {"skill_overlap": 0.25, "kg_skill_distance": 0.20, "dense_similarity": 0.20, "bm25_score": 0.10, "trajectory_alignment": 0.10, "behavioral_score": 0.10, "seniority_match": 0.05}


def jaccard(a: Column, b: Column) -> Column:
    a, b = (F.filter(F.array_distinct(x), lambda s: s != "") for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def closeness(mean_distance: Column, has_required: Column) -> Column:
    """1 / (1 + mean distance of the required skills, at most 3 each); 1 where nothing is required."""
    return F.when(has_required, 1 / (1 + F.coalesce(mean_distance, F.lit(3.0)))).otherwise(1.0)


def dense_similarity(cos: Column) -> Column:
    return (F.coalesce(cos, F.lit(0.0)) + 1) / 2


def squashed(bm25: Column) -> Column:
    return F.when(bm25 > 0, bm25 / (bm25 + 8)).otherwise(0.0)


def trajectory(avg_months: Column, roles: Column) -> Column:
    return F.when(roles > 0, 0.5 * F.least(F.lit(1.0), avg_months / 24) + 0.5 * F.least(F.lit(1.0), roles / 3)).otherwise(0.5)


def behaviour(recency: Column, frequency: Column, velocity: Column, breadth: Column, confidence: Column) -> Column:
    """Drawn towards 0.5 as confidence falls; 0.5 without a profile."""
    raw = 0.4 * recency + 0.3 * frequency + 0.2 * velocity + 0.1 * breadth
    return F.coalesce(raw * confidence + 0.5 * (1 - confidence), F.lit(0.5))


def seniority(years: Column, wanted: Column) -> Column:
    need = expected_years(wanted)
    return F.when(need.isNull() | years.isNull() | (years >= need), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (need - years) / need))


def weighted(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the features that aren't null; 0 if none has weight."""
    weights = WEIGHTS if weights is None else weights
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    total = add([F.when(features[k].isNull(), 0.0).otherwise(F.lit(float(w))) for k, w in weights.items()])
    return F.when(total > 0, add([F.coalesce(features[k], F.lit(0.0)) * w for k, w in weights.items()]) / total).otherwise(0.0)


def breakdown(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """What each feature adds to the weighted score, before penalties."""
    weights = WEIGHTS if weights is None else weights
    total = reduce(lambda a, b: a + b, [F.when(features[k].isNull(), 0.0).otherwise(F.lit(float(w))) for k, w in weights.items()])
    return F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.when(total > 0, F.coalesce(features[k], F.lit(0.0)) * w / total).otherwise(0.0))])


def penalised(score: Column, negatives: Column, positives: Column, flagged: Column) -> Column:
    """negatives: how many rules are broken. Many positives soften the penalty; flagged rows keep a hundredth."""
    n = F.coalesce(negatives, F.lit(0))
    factor = F.when(n <= 0, 1.0).when(positives >= 5, F.greatest(F.lit(0.0), 1 - 0.1 * n)).otherwise(F.pow(F.lit(0.5), n))
    return score * factor * F.when(flagged, 0.01).otherwise(1.0)


def composite_a(bm25: Column, positive: Column, notice: Column, verified: Column, multiplier: Column, flagged: Column) -> Column:
    raw = 0.40 * bm25 + 0.30 * positive + 0.15 * notice + 0.15 * F.when(verified, 1.0).otherwise(0.5)
    return F.when(flagged, 0.0).otherwise(raw * multiplier)


def blended(rerank: Column, score: Column, alpha: float = 0.5) -> Column:
    return alpha * rerank + (1 - alpha) * score


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def rerank_offline(query_text: Column, text: Column) -> Column:
    """Token-set ratio with the whole text, 0..1. A Python function: call it on shortlists only."""
    from rankloom.functions.text import token_set

    return token_set(query_text, text) / 100


def rerank_by_model(query_text: Column, text: Column, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Column:
    """A pair model's logits as 0..1. Each worker loads the model once; pairs go to it a batch at a time. For shortlists only."""

    @F.pandas_udf("double")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series([float(x) for x in model(list(zip(a.fillna(""), b.fillna(""))))], dtype="float64")

    return sigmoid(logits(query_text, text))
