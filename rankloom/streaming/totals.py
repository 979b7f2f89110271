"""Activity of users, kept as totals that a new day of events is added to, and the population's scale made from them.

A user's row holds what can be put together from parts: sums, counts, the last time and the set of kinds. A batch of events becomes such
parts, which are laid into the stored rows of the same users; no event is read twice, and buckets without new events are left as they
are. Ends of the metrics are an aggregate of the totals, of one row a user. Each batch has a name; a batch that is given again changes nothing,
so a job that broke off can be repeated, and a stream can be written by its batches' numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behaviour
from rankloom.sources.keyed import Keyed

#: What a user's parts are put together by.
PARTS = {"frequency": F.sum, "n": F.sum, "last": F.max}


def parts(events: DataFrame, batch: str) -> DataFrame:
    """user_id, frequency (values, 1 where there is none), n, last, kinds (a set) and batches of events (ts, user_id, event_type, value)."""
    return events.groupBy("user_id").agg(F.sum(F.coalesce("value", F.lit(1.0))).alias("frequency"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.array_sort(F.collect_set("event_type")).alias("kinds"), F.array(F.lit(batch)).alias("batches"))


def joined(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new parts put together by user. Of a batch that a user's row has already, the new part is left out."""
    known = old.select(F.col("user_id").alias("_u"), F.col("batches").alias("_b"))
    fresh = new.join(known, F.col("user_id").eqNullSafe(F.col("_u")), "left").filter(~F.coalesce(F.arrays_overlap("batches", "_b"), F.lit(False))).select(new.columns)
    return old.unionByName(fresh).groupBy("user_id").agg(*[f(c).alias(c) for c, f in PARTS.items()], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("kinds", "batches")])


class Totals:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.stored = Keyed(spark, path, "user_id", buckets)

    def add(self, events: DataFrame, batch: str) -> None:
        self.stored.upsert(parts(events, batch), joined)

    def rows(self, as_of: str) -> DataFrame:
        """user_id, frequency, recency, kinds (how many) and n."""
        return self.stored.rows().select("user_id", "frequency", behaviour.recency(F.col("last").cast("date"), as_of).alias("recency"), F.size("kinds").alias("kinds"), "n")

    def scaled(self, as_of: str, metrics: tuple[str, ...] = ("frequency", "recency")) -> DataFrame:
        return behaviour.population_scaled(self.rows(as_of).select("user_id", *metrics), metrics)

    def follow(self, events: DataFrame, checkpoint: str):
        """Adds a stream's batches as they come; each is added once, whatever is repeated."""
        return events.writeStream.foreachBatch(lambda batch, number: self.add(batch, f"{checkpoint}#{number}")).option("checkpointLocation", checkpoint)
