"""Resampling documents towards a target distribution by importance weights (operator 13).

Features of a text are its runs of 1 to `longest` words, joined by one space; a feature's bucket is the crc32 of its bytes modulo
`buckets`. A bucket's gain says how much more often the target's texts have it than the documents do, a text's weight is the
floored mean of its features' gains, and a document's score is its text's weight and a noise that its id alone decides. The
documents with the highest scores are drawn (the Gumbel top-k trick: a draw without replacement by exp(weight / 1000)).

Equal texts are one row before anything is computed: documents are grouped by their full text, features are computed once for a
text and written, their counts are multiplied by the text's number of copies, and weights are joined back to documents by the
text's SHA-256. Texts with many copies (more than 1 / HOT of all rows, so at most HOT texts) go by a broadcast table instead of
the join, so that no key of the join holds more than that share of the rows.

Drawing has no sort of all rows: scores are integers, and what all bits of counts and ids can give bounds them to less than
200,000 values, so a histogram gives the least score drawn; only rows from there on are sorted, by ranges of (score, id, row),
and places come from the counts of the ranges.

Null text has no words, and weight 0. Null ids get the noise of an empty id and come last in ties. Repeated rows are drawn each on
its own. Very long texts are one row in an Arrow batch, never more than one at a time beside their words. An empty table gives an
empty result, and an empty target gives gains against counts of zero. Columns other than those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import texts, written

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
HOT = 1_000
#: Ranges of drawn rows; a range is a sort in one task.
RANGE_ROWS = 1 << 20
#: Word bytes are kept, A-Z lower-cased, everything else separates.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, the bucket of every feature, repeats included)."""
    words = text.translate(WORDS).split()
    runs = [words, *([b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, longest + 1))]
    return len(words), np.fromiter((crc32(w) for run in runs for w in run), np.uint32, sum(map(len, runs))) % np.uint32(buckets)


def text_key(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def distinct_texts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, name: str = "features") -> DataFrame:
    """key, copies, n_words, n_features and found (the buckets of its features, as little-endian 32-bit numbers) of each distinct text, as a table."""
    one = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t, longest, buckets) for t in texts(batch, "text")]
            columns = [batch.column(0), batch.column(1), pa.array([n for n, _ in made], pa.int64()), pa.array([len(f) for _, f in made], pa.int64()), pa.array([f.astype("<u4").tobytes() for _, f in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "copies", "n_words", "n_features", "found"])

    # The key comes first, so that the text itself ends with the Arrow batch.
    keyed = one.select(text_key().alias("key"), "copies", "text")
    return written(keyed.mapInArrow(run, "key binary, copies long, n_words long, n_features long, found binary"), name)


def bucket_counts(distinct: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features all texts, copies included, have in each bucket. A task adds up its texts; `buckets` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += copies * np.bincount(np.frombuffer(found, "<u4"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in distinct.select("copies", "found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of (the target's smoothed share of a bucket / the documents'))."""
    n, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source, target)], np.int64)


def weighed(distinct: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features and weight of each distinct text, as a table. The gains are `buckets` numbers, whatever the input."""
    shared = distinct.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x, "<u4") for x in batch.column(4).to_pylist()]
            weight = [int(shared.value[x].sum()) // len(x) if len(x) else 0 for x in each]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], names=[*batch.schema.names[:4], "weight"])

    return written(distinct.select("key", "copies", "n_words", "n_features", "found").mapInArrow(run, "key binary, copies long, n_words long, n_features long, weight long"), "weights", instead_of=distinct)


def joined(docs: DataFrame, weights: DataFrame, doc_id: str, text: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"))
    total = weights.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = F.col("copies") > max(1, total // hot)
    columns = ["doc_id", "n_words", "n_features", "weight"]
    # At most `hot` texts can have more than 1 / hot of all rows each: this is the bound of what is broadcast.
    few = weights.filter(often).select(F.col("key").alias("k"), F.col("n_words").alias("w"), F.col("n_features").alias("f"), F.col("weight").alias("g"))
    at_once = rows.join(F.broadcast(few), F.col("key") == F.col("k"), "left")
    # A row with a frequent text carries no key any more: its join key is null, which a left join neither shuffles to a match nor groups.
    rest = at_once.filter("k is null").select("doc_id", "key").join(weights.filter(~often).hint("merge"), "key").select(columns)
    return at_once.filter("k is not null").select("doc_id", F.col("w").alias("n_words"), F.col("f").alias("n_features"), F.col("g").alias("weight")).unionByName(rest)


def noise(doc_id: str, seed: int = SEED):
    """floor(1000 * a Gumbel variate) that the seed and the id decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """scored (a table: doc_id, score, eligible and others) with rank: 1, 2, ... for the first `draw` eligible rows by falling score,
    ties to the smaller doc_id; null for all others."""
    spark, nothing = scored.sparkSession, F.lit(None).cast("long")
    if not draw:
        return scored.withColumn("rank", nothing)
    # The histogram has one row for each integer score, of which there are less than 200,000.
    histogram = scored.filter("eligible").groupBy("score").count()
    falling = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = histogram.withColumn("so_far", F.sum("count").over(falling)).filter(F.col("so_far") >= draw).agg(F.max("score")).first()[0]
    in_reach = F.col("eligible") & (F.col("score") >= least)
    parts = -(-draw // RANGE_ROWS) * max(1, min(200, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    sorted_ = scored.filter(in_reach).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id's upper bits are the partition, its lower 33 the place in it.
    placed = written(sorted_.withColumn("at", F.monotonically_increasing_id()), "drawn").withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("at") + 1
    drawn = placed.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= draw, rank)).drop("part", "at", "row", "start")
    return scored.filter(~F.coalesce(in_reach, F.lit(False))).withColumn("rank", nothing).unionByName(drawn)


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs: `percent` of those with `least_words` words are drawn."""
    distinct = distinct_texts(docs, text, longest, buckets)
    wanted = distinct_texts(target, text, longest, buckets, "target-features")
    gain = gains(bucket_counts(distinct, buckets), bucket_counts(wanted, buckets))
    weights = weighed(distinct, gain)
    scored = joined(docs, weights, doc_id, text).withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("eligible", F.col("n_words") >= least_words)
    scored = written(scored.select("doc_id", "n_features", "weight", "score", "eligible"), "scored")
    return ranked(scored, percent * scored.filter("eligible").count() // 100).select("doc_id", "n_features", "weight", "score", "rank")
