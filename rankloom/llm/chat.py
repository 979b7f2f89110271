"""Collapse of cumulative conversation snapshots, then rendering (operator 5). DataFrame functions only.

Logs often hold a conversation again and again as it grows. Each turn gets a rolling hash of itself and all turns before
it. A conversation whose last hash is an inner hash of another is a prefix of that one and goes, by an anti-join; of
conversations with the same turns the one with the smallest id stays. What remains is rendered turn by turn.

Turns come in the order of turn, then role, then text; nulls sort first and count as empty strings. Repeated rows are
repeated turns. Nothing says which rows without conv_id belong together, so each is a conversation of one turn, and such
rows never meet in one task. A conversation's turns do, as its text is one string: the longest one must fit an executor.
Repeated conversations count as copies; a conversation of null id stays only if no copy has an id. An empty table gives an
empty result. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import written

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return known.unionByName(turns.filter("conv_id is null").select("conv_id", F.array(one).alias("turns")))


def prefixes(conversations: DataFrame) -> DataFrame:
    """row, conv_id, n (turns up to here), a and b (the rolling hash, 128 bits) and last, for each turn.

    A turn's hash holds its place, so their running exclusive-or is a hash of the sequence; the texts stay behind."""
    keyed = conversations.select("row", "conv_id", F.size("turns").alias("size"), F.posexplode(F.transform("turns", lambda t, i: F.struct(F.xxhash64(i, t["role"], t["text"]).alias("a"), F.xxhash64(F.lit("b"), t["text"], t["role"], i).alias("b")))).alias("i", "h"))
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return keyed.select("row", "conv_id", (F.col("i") + 1).alias("n"), F.bit_xor("h.a").over(so_far).alias("a"), F.bit_xor("h.b").over(so_far).alias("b"), (F.col("i") + 1 == F.col("size")).alias("last"))


def maximal(conversations: DataFrame) -> DataFrame:
    """row of the conversations that prefix no other, one for each sequence of turns, with n_copies (how many had it)."""
    seen = prefixes(conversations)
    first = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "row"))["row"]
    ends = seen.filter("last").groupBy("n", "a", "b").agg(first.alias("row"), F.count(F.lit(1)).alias("n_copies"))
    inner = seen.filter("not last").select("n", "a", "b").distinct()
    return ends.join(inner, ["n", "a", "b"], "left_anti").select("row", "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat (the rendered text) of each maximal conversation."""
    all_ = written(gathered(turns.select("conv_id", "turn", "role", "text")).withColumn("row", F.monotonically_increasing_id()), "conversations")
    parts = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE)))
    return all_.join(maximal(all_), "row").select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(parts, "").alias("chat"))
