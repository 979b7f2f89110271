"""Mixing sources to target weights by a low-discrepancy schedule (operator 6).

Sources get weights, which share out the words of the mix up to a bound for each source. The schedule has a slot for every
BLOCK words of the mix. Golden-ratio points, mapped through the cumulative shares, say which source a slot takes from; slots
are ranked within their source; the slot of rank r takes block r of the source's shuffled stream: its documents in the order
of a hash, repeated `passes` times and cut into blocks of BLOCK words. A slot's words are thus parts of a few documents, and
what is taken of a document is what slots take. The points alone decide how many slots a source gets; their discrepancy is
that of a few slots, so a source ends within a few blocks of its target. Blocks beyond the stream's end are short or empty,
so no document is taken more than `passes` times.

Null text has size 0 and null is a source of its own, the last. Sources of size 0 have target 0. Repeated rows are taken
each on its own; equal hashes tie in any order, which moves words between rows of the same id and size only. An empty table
gives an empty mix. Columns other than doc_id, source and text are not read. Nothing depends on how rows are partitioned,
so reruns agree. Windows over sources hold one row a source; ranks are counted by chunk of CHUNK slots.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import running_total, texts, with_columns, written

BLOCK = 32
WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
CELLS = 1024
CHUNK = 1 << 14
#: 2 ** 32 divided by the golden ratio, as an odd integer: t * STEP mod 2 ** 32 are the golden-ratio points.
STEP = 2654435769


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and ord (60 bits of a hash that shuffles) of every row; row tells equal rows apart."""
    counted = with_columns(docs.select("doc_id", "source", "text"), lambda b: {"size": [len(x.split()) for x in texts(b, "text")]}, {"size": "long"}, ["doc_id", "source"])
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    return written(counted.withColumn("ord", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).withColumn("row", F.monotonically_increasing_id()), "sized")


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """For each source: s (its number, by code point, null last), source, source_size, target, goal (whole words), lo and hi (its
    part of the shares). One row for each source, so the windows here see no documents.

    A source whose weight would give it more than `passes` times its size stops there; all others share the rest by weight.
    Ordered by bound / weight, the full ones come first, and the level is that of the first source that isn't full."""
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("w", w).withColumn("bound", F.col("source_size") * float(passes))
    up = Window.orderBy(F.col("bound") / F.col("w"), "s")
    total = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    full = F.coalesce(F.sum("bound").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - full) / rest).withColumn("level", F.first(F.when(F.col("bound") / F.col("w") >= F.col("level") - 1e-9, F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    per = per.withColumn("target", F.least("bound", F.col("level") * F.col("w"))).withColumn("goal", F.floor(F.col("target") + 1e-6))
    by_s = Window.orderBy("s")
    all_goals = F.sum("goal").over(Window.partitionBy())
    hi = F.sum("goal").over(by_s.rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(all_goals, F.lit(1))
    lo = F.coalesce(F.sum("goal").over(by_s.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.greatest(all_goals, F.lit(1))
    return per.select("s", "source", "source_size", "target", "goal", lo.alias("lo"), hi.alias("hi"))


def schedule(mix: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, s and rank (the block of s's stream that the slot takes), for sources as `targets` gives them.

    Points meet shares in CELLS equal cells, an equi-join that needs no broadcast; ranks come from counts by chunk of slots."""
    words = mix.agg(F.sum("goal")).first()[0] or 0
    slots = mix.sparkSession.range(math.ceil(words / block)).select(F.col("id").alias("slot"), ((F.col("id") % (1 << 31) * STEP % (1 << 32)) / float(1 << 32)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    shares = mix.filter("goal > 0").select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least(F.col("hi"), F.lit(1 - 1e-12)) * CELLS))).alias("cell"))
    placed = slots.hint("merge").join(shares, "cell").filter("u >= lo and u < hi").select("slot", "s", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("s", "chunk").count().select("s", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return placed.withColumn("at", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1).join(starts, ["s", "chunk"]).select("slot", "s", (F.col("start") + F.col("at")).alias("rank"))


def streams(docs: DataFrame, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(the rows of docs as `sized` gives them, with their source's number, size and target and their place `pos` in its stream; the sources)."""
    rows = sized(docs)
    mix = written(targets(rows, passes=passes), "targets")
    rows = rows.join(mix.select(F.col("source").alias("of"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return written(running_total(rows, "s", "ord", "size", "pos", width=60), "placed"), mix


def slotted(placed: DataFrame, mix: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """The mix itself: slot, s, row, doc_id, begin and end, the words (from 0) of the row that the slot takes. In the order of slot
    and, within it, of `place` (of its first word in the source's stream), the rows are the mixed corpus."""
    start = F.col("pass") * F.col("source_size") + F.col("pos")
    pieces = placed.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("start", start)
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    first, last = F.greatest(F.col("start"), F.col("rank") * block), F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * block)
    pieces = pieces.select("row", "doc_id", "s", "rank", first.alias("place"), (first - F.col("start")).alias("begin"), (last - F.col("start")).alias("end"))
    # Numbers in a row shrink so well that a shuffled schedule looks small enough to broadcast, which it isn't.
    return pieces.hint("merge").join(schedule(mix, block), ["s", "rank"]).select("slot", "s", "place", "row", "doc_id", "begin", "end")


def mixed(docs: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of the row that the mix takes, repeats counted) of every row."""
    placed, mix = streams(docs, passes)
    took = slotted(placed, mix, block, passes).groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("took"))
    return placed.join(took, "row", "left").select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), F.coalesce("took", F.lit(0)).cast("long").alias("taken"))
