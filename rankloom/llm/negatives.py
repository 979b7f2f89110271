"""Hard negatives by full score sorts (operator 11).

Anchors are a stated set of rows; every anchor meets all rows. Rows lie in blocks of about ROWS, anchors in blocks of about ANCHORS, by a
hash of a row's number, so neither a label nor a vector that many rows share makes a block larger. A pair of blocks is one matrix
product of whole numbers, and one row of the join that deals the pairs out: the anchors' blocks, the smaller side, are repeated for each
block of rows.

Two passes over the pairs. The first keeps each anchor's best rows of its label, `positives` a block, and their best over all blocks.
The second sorts, for each anchor, all rows of other labels of the block by score and id (a lexsort), binary-searches the
place where scores fall to a positive's upper limit, and reads `k` entries from there on while they reach its lower limit. The first
`k` of an anchor and positive are among the first `k` of its blocks, so the last cut is exact. Both passes keep a block pair's scores
and no more in memory; what they give is bounded by the number of pairs, never by a label's or an anchor's rows.

Components become floor(scale * x), x as double. Scores are exact as long as the sums of absolute products fit 63 bits; they are summed as doubles
where those stay below 2 ** 53, else as 64-bit integers. Components beyond 31 bits saturate there. Rows with a null label, a null
vector, or a null or non-finite component take no part; a vector that is shorter than another counts as padded by zeros. A null id is no
anchor and comes last in ties. Repeated rows count each on its own: each copy of an anchor is an anchor, and has its other copies
among its positives. Rows of equal score and id come in the order of their numbers. Empty tables give no rows. Columns other
than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import written

ROWS, ANCHORS = 1 << 14, 1 << 8
#: Cells of one matrix product in memory.
CELLS = 1 << 21
POSITIVES, NEGATIVES = 5, 3
LOWER, UPPER = 50, 95
SCALE = 256
MOST = (1 << 31) - 1
LAST = np.iinfo(np.int64).max
BLOCK = "n long, dim int, row binary, id binary, has binary, label binary, vector binary"


def usable(vectors: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """id, label, vector (of doubles) and row (its number) of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).withColumn("row", F.monotonically_increasing_id())


def blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(the rows, about `size` in a block: block, and their numbers, ids, labels and quantised vectors as bytes, by id; how many blocks
    rows were dealt to). A table."""
    many = max(1, -(-rows.count() // size))

    def pack(table: pa.Table) -> pa.Table:
        vectors = table.column("vector").combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
        dim = int(lengths.max(initial=0))
        held = np.zeros((len(lengths), dim), np.int32)
        held[np.arange(dim)[None, :] < lengths[:, None]] = np.clip(np.floor(vectors.flatten().to_numpy() * float(SCALE)), -MOST, MOST).astype(np.int32)
        ids = table.column("id").combine_chunks()
        by_id = np.lexsort((table.column("row").to_numpy(), ids.fill_null(LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        raw = {"row": table.column("row").to_numpy(), "id": ids.fill_null(LAST).to_numpy(), "has": ids.is_valid().to_numpy(zero_copy_only=False).astype("u1"), "label": table.column("label").to_numpy(), "vector": held}
        out = {"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "n": pa.array([len(lengths)], pa.int64()), "dim": pa.array([dim], pa.int32())}
        return pa.table(out | {k: pa.array([x[by_id].tobytes()], pa.binary()) for k, x in raw.items()})

    return written(rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(many))).groupBy("block").applyInArrow(pack, f"block long, {BLOCK}"), name), many


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, ids, whether a row has one, labels, vectors) of a block."""
    long = lambda c: np.frombuffer(row[prefix + c], np.int64)
    return long("row"), long("id"), np.frombuffer(row[prefix + "has"], "u1").astype(bool), long("label"), np.frombuffer(row[prefix + "vector"], np.int32).reshape(row[prefix + "n"], row[prefix + "dim"])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, as whole numbers."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = dim * int(np.abs(a, dtype=np.int64).max(initial=0)) * int(np.abs(b, dtype=np.int64).max(initial=0))
    kind = np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def paired(anchors: DataFrame, rows: DataFrame, many: int) -> DataFrame:
    """Each block of anchors (its columns with a_ before their names) with each of the `many` blocks of rows, an equi-join on the number of the rows' block.

    Both sides are dealt by that number and merged. A broadcast would be planned by the size of the anchors' files, and bring them to the driver `many` times."""
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    held = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"], places.alias("block"))
    tasks = max(many, anchors.sparkSession.sparkContext.defaultParallelism)
    return held.repartition(tasks, "block").hint("merge").join(rows.repartition(tasks, "block").hint("merge"), "block")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a block pair is some megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def parts(row: dict):
    """Slices of the anchors of a block pair whose scores fit CELLS."""
    step = max(1, CELLS // max(1, row["n"]))
    return [(lo, min(row["a_n"], lo + step)) for lo in range(0, row["a_n"], step)]


def rows_of(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in columns], names=names)


def positives(pairs: DataFrame, most: int) -> DataFrame:
    """anchor (its row's number), and its first `most` other rows of its label: id, whether it has one, score and place from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in each(batches):
            (a_row, _, _, a_label, a_vector), (b_row, b_id, b_has, b_label, b_vector) = unpacked(pair, "a_"), unpacked(pair)
            found: list[tuple] = []
            for lo, hi in parts(pair):
                s = scores(a_vector[lo:hi], b_vector)
                for i in range(lo, hi):
                    mine = np.flatnonzero((b_label == a_label[i]) & (b_row != a_row[i]))
                    s_i = s[i - lo][mine]
                    if len(mine) > most:
                        near = s_i >= np.partition(s_i, len(s_i) - most)[len(s_i) - most]
                        mine, s_i = mine[near], s_i[near]
                    order = np.lexsort((mine, -s_i))[:most]  # A block's rows lie in the order of their ids.
                    found += [(a_row[i], b_row[j], b_id[j] if b_has[j] else None, x) for j, x in zip(mine[order], s_i[order])]
            yield rows_of(found, ["anchor", "other", "positive_id", "positive_score"])

    near = pairs.mapInArrow(run, "anchor long, other long, positive_id long, positive_score long")
    window = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "other")
    return near.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= most)


def negatives(pairs: DataFrame, k: int, lower: int, upper: int) -> DataFrame:
    """anchor_id, positive_id, negative_id, positive_score, negative_score and rank, for pairs whose anchors bring their positives along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in each(batches):
            (a_row, a_id, _, a_label, a_vector), (b_row, b_id, b_has, b_label, b_vector) = unpacked(pair, "a_"), unpacked(pair)
            wanted: dict[int, list] = {x["anchor"]: x["found"] for x in pair["a_wanted"]}
            found: list[tuple] = []
            for lo, hi in parts(pair):
                s = scores(a_vector[lo:hi], b_vector)
                for i in range(lo, hi):
                    other = np.flatnonzero(b_label != a_label[i])
                    falling = -s[i - lo][other]
                    order = np.lexsort((other, falling))  # A block's rows lie in the order of their ids.
                    other, falling = other[order], falling[order]
                    for p in wanted.get(int(a_row[i]), []):
                        # 100 * score <= upper * positive, and 100 * score >= lower * positive, in whole numbers.
                        first = int(np.searchsorted(falling, -(upper * p["positive_score"] // 100), side="left"))
                        end = int(np.searchsorted(falling, lower * -p["positive_score"] // 100, side="right"))
                        for j in range(first, min(first + k, end)):
                            found.append((a_row[i], a_id[i], p["place"], p["positive_id"], p["positive_score"], b_row[other[j]], b_id[other[j]] if b_has[other[j]] else None, -falling[j]))
            yield rows_of(found, ["anchor", "anchor_id", "place", "positive_id", "positive_score", "other", "negative_id", "negative_score"])

    near = pairs.mapInArrow(run, "anchor long, anchor_id long, place long, positive_id long, positive_score long, other long, negative_id long, negative_score long")
    window = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "other")
    return near.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", n_positives: int = POSITIVES, k: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its first `n_positives` rows of
    the same label, the first `k` rows of other labels whose score is between `lower` and `upper` hundredths of the positive's.

    anchor: a condition on the column id. label: a column or its name, in terms of vectors."""
    numbered = written(usable(vectors, vec_id, vector, F.col(label) if isinstance(label, str) else label), "vectors")
    (of_rows, many_rows), (of_anchors, many_anchors) = blocks(numbered, rows, "rows"), blocks(numbered.filter(anchor), anchors, "anchors")
    found = written(positives(paired(of_anchors, of_rows, many_rows), n_positives), "positives")
    # An anchor's block follows from its number, as in `blocks`; n_positives rows an anchor, and a block's anchors, meet in one task.
    wanted = found.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("found"))
    wanted = wanted.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(many_anchors)).alias("block")).agg(F.collect_list(F.struct("anchor", "found")).alias("wanted"))
    near = negatives(paired(of_anchors.join(wanted, "block"), of_rows, many_rows), k, lower, upper)
    return near.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
