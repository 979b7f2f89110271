"""Removal of repeated substrings over shards of sampled suffixes (operator 2).

Every byte that a string of WINDOW bytes covers which also starts anywhere else goes. As in a merge by interleave refinement,
all suffixes start as one block, and each round refines blocks by what their suffixes read next, until a block is alone or
its common prefix is long enough; a settled block takes part in no further round. It is not a merge of Burrows-Wheeler
transforms, for which the README has figures: suffixes are sampled, and blocks have names instead of places in an order. A
shard (an Arrow batch of texts) does its part of a round by itself; between shards only the names meet, as hashes.

  1. A window's anchor is the place of its least hashed gram of GRAM bytes. It depends on the window's content only, so
     equal windows have equal grams at equal places. Neighbouring windows with one anchor are a run. Runs are blocked by
     gram; blocks of one run end here. Runs of a block whose whole stretch of text is equal are repeated intervals.
  2. What is left in blocks of different stretches is cut where windows are a STEP further from the anchor, and blocked by
     the text that all windows of such a piece share: WINDOW - STEP + 1 bytes are then the common prefix of a block.
  3. So on with smaller steps, at last window by window.
A block's name is a 64-bit hash of the text it shares and its place; equality is by two of them at the least (block and
stretch). At each round one member of each kind of stretch goes on, so copies do not multiply. A text that occurs several
times is repeated as a whole; a shard reads it once, and for others its copies count as one. Hot blocks are only counted
and joined, never gathered; what is gathered is at most one entry for each window of one text.

Null text counts as empty and keeps nothing. Texts shorter than WINDOW keep everything. Repeated rows remove each other
where they reach WINDOW bytes. Empty tables give empty results. Positions are bytes of UTF-8; what remains need not be valid
UTF-8. Texts of any length are read in segments. Columns with the name of a new one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import dropped, texts, with_columns, written

WINDOW = 400
GRAM = 16
STEPS = (32, 1)
SEGMENT = 1 << 20
#: So many keys of texts a shard remembers at once.
SEEN = 1_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
PIECE = "key binary, start int, n int, ahead int, block long, stretch long"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Stream:
    """A stretch of bytes whose substrings of eight bytes or more can be hashed at once."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, dtype=np.uint8)
        n = max(0, len(raw) - 7)
        self.eight = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            self.eight |= raw[j : j + n].astype(np.uint64) << np.uint64(8 * j)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.eight) * powers(MULTIPLIER, n))])
        self.inverse = powers(pow(MULTIPLIER, -1, 1 << 64), n + 1)

    def hashes(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size - 7] - self.sums[start]) * self.inverse[start])

    def anchors(self, window: int) -> np.ndarray:
        """For each place: that of the least hashed gram in the window there, the first of equal ones."""
        span = window - GRAM + 1
        m = len(self.eight) - (GRAM - 8)
        count = m - span + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64)
        low = np.uint64((1 << 24) - 1)
        grams = mix(mix(self.eight[:m]) + self.eight[GRAM - 8 :] * np.uint64(MULTIPLIER))
        order = np.full(-(-m // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
        order[:m] = (grams & ~low) | np.arange(m, dtype=np.uint64)
        order = order.reshape(-1, span)
        ahead = np.minimum.accumulate(order, axis=1).ravel()
        behind = np.minimum.accumulate(order[:, ::-1], axis=1)[:, ::-1].ravel()
        return (np.minimum(behind[:count], ahead[span - 1 : span - 1 + count]) & low).astype(np.int64)


def runs(rows: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """Round 1: (row, start, n, ahead, block, stretch) of the runs of each text; ahead: from the start to the anchor."""
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    long = np.flatnonzero(sizes >= window)
    if not len(long):
        return
    data = b"".join([rows[i] for i in long])
    ends = np.cumsum(sizes[long])
    begins = ends - sizes[long]
    for at in range(0, len(data) - window + 1, SEGMENT):
        part = Stream(data[at : at + SEGMENT + window - 1])
        anchor = part.anchors(window)
        place = np.arange(at, at + len(anchor))
        row = np.searchsorted(ends, place, side="right")
        inside = np.flatnonzero(place + window <= ends[row])
        if not len(inside):
            continue
        a = anchor[inside]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (inside[1:] != inside[:-1] + 1)]))
        n = np.diff(np.append(first, len(inside)))
        start, a = inside[first], a[first]
        block = part.hashes(a, GRAM)
        stretch = mix(part.hashes(start, n + window - 1) + n.astype(np.uint64) * np.uint64(1 << 20) + (a - start).astype(np.uint64))
        which = row[start]
        yield long[which], start + at - begins[which], n, a - start, block, stretch


def cut(rows: list[bytes], row: np.ndarray, start: np.ndarray, n: np.ndarray, ahead: np.ndarray, step: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """The later rounds: the given runs cut where the distance to the anchor is a multiple of `step`; the same columns as of `runs`."""
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    stream = Stream(b"".join(rows))
    last, first = (ahead - n + 1) // step, ahead // step
    times = first - last + 1
    of = np.repeat(np.arange(len(row)), times)
    q = last[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    anchor = start[of] + ahead[of]
    low, high = np.maximum(start[of], anchor - q * step - step + 1), np.minimum(start[of] + n[of] - 1, anchor - q * step)
    base = begins[row[of]]
    block = mix(stream.hashes(base + anchor - q * step, window - step + 1) + q.astype(np.uint64) * np.uint64(MULTIPLIER))
    stretch = mix(stream.hashes(base + low, high - low + window) + (anchor - low).astype(np.uint64) * np.uint64(1 << 20) + (high - low).astype(np.uint64))
    return row[of], low, high - low + 1, anchor - low, block, stretch


def as_batches(keys: list, columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    row, start, n, ahead, block, stretch = columns
    for at in range(0, len(row), 100_000):
        s = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in row[s]], pa.binary()), *[pa.array(x[s].astype(np.int32)) for x in (start, n, ahead)], *[pa.array(x[s].view(np.int64)) for x in (block, stretch)]], names=["key", "start", "n", "ahead", "block", "stretch"])


def slices(batch: pa.RecordBatch, column: str, most: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in a text column."""
    sizes = np.cumsum([0, *[len(x) for x in texts(batch, column)]])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def segments(text: bytes, row: np.ndarray, start: np.ndarray, n: np.ndarray, ahead: np.ndarray, step: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """`cut` of the runs of one text, by segments of it."""
    for at in range(0, len(text), SEGMENT):
        here = np.flatnonzero((start >= at) & (start < at + SEGMENT))
        if len(here):
            out = cut([text[at : at + SEGMENT + 2 * window]], row[here], start[here] - at, n[here], ahead[here], step, window)
            yield out[0], out[1] + at, *out[2:]


def refined(pieces: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(the pieces whose whole stretch is repeated, one piece of each stretch in blocks that have several). pieces goes.

    The one of a stretch is that with the least place, so that all that is grouped are numbers."""
    pieces_table, pieces = pieces, pieces.withColumn("place", F.xxhash64("key", "start"))
    kinds = pieces.groupBy("block", "stretch").agg(F.min("place").alias("one"), (F.min("place") != F.max("place")).alias("again"))
    if last:
        kinds = kinds.filter("again").withColumn("mixed", F.lit(False))
    else:
        several = kinds.groupBy("block").agg((F.count(F.lit(1)) > 1).alias("mixed"))
        kinds = kinds.join(several, "block").filter("again or mixed")
    told = pieces.join(kinds, ["block", "stretch"]).select("key", "start", "n", "ahead", "again", (F.col("mixed") & (F.col("place") == F.col("one"))).alias("on")).filter("again or on")
    told = written(told, "told", instead_of=pieces_table, few=True)
    left = told.filter("on").select("key", "start", "n", "ahead").distinct()  # a text that several shards read counts once
    return told.filter("again").select("key", "start", "n"), None if last else left


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key and marks (starts and lengths of runs of repeated windows) of the texts of docs (key, text) that have any."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys = part.column(0).to_pylist()
                rows = [b"" if k in seen or seen.add(k) else x for k, x in zip(keys, texts(part, "text"))]
                for columns in runs(rows, window):
                    yield from as_batches(keys, columns)
                if len(seen) > SEEN:
                    seen.clear()

    copies = docs.groupBy("key", F.octet_length("text").alias("size")).count().filter((F.col("count") > 1) & (F.col("size") >= window))
    pieces = written(docs.mapInArrow(first, PIECE), "runs")
    marks, left = refined(pieces)
    open_ = written(docs.join(left.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "open")
    all_marks = [marks, copies.select("key", F.lit(0).alias("start"), (F.col("size") - window + 1).alias("n"))]
    steps = [s for s in STEPS if 2 * s <= window]
    for step in steps:
        per_text = left.groupBy("key").agg(F.collect_list("start").alias("start"), F.collect_list("n").alias("n"), F.collect_list("ahead").alias("ahead"))

        def further(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    lists = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("start", "n", "ahead")]
                    flat = [np.array([v for x in xs for v in x], dtype=np.int64) for xs in lists]
                    row = np.repeat(np.arange(part.num_rows), [len(x) for x in lists[0]])
                    rows = texts(part, "text")
                    for columns in segments(rows[0], row, *flat, step, window) if len(rows) == 1 else [cut(rows, row, *flat, step, window)]:
                        yield from as_batches(part.column(0).to_pylist(), columns)

        pieces = written(open_.join(per_text, "key").select("key", "text", "start", "n", "ahead").mapInArrow(further, PIECE), "pieces")
        marks, left = refined(pieces, step == 1)
        all_marks.append(marks)
    dropped(open_)
    return reduce(DataFrame.unionByName, all_marks).groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("marks")).select("key", F.col("marks.start").alias("starts"), F.col("marks.n").alias("counts"))


def removed(size: int, starts: list[int] | None, counts: list[int] | None, window: int = WINDOW) -> list[tuple[int, int]]:
    """The maximal stretches that the windows of the given runs cover."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts or (), counts or ())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + window)
        else:
            out.append([s, s + n - 1 + window])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, bytes_out: bool = False) -> DataFrame:
    """docs' columns `keep` with n_bytes, n_removed, n_spans, kept_sha256 and, on demand, kept (the remaining bytes) of every row."""
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept": "binary"} if bytes_out else {})
    keep = ["doc_id"] if keep is None else keep
    names = {c: f"__dedup_{i}" for i, c in enumerate(keep) if c not in new}
    docs = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    marked = docs.join(repeated(docs.select("key", "text"), window), "key", "left")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, starts, counts in zip(texts(batch, "text"), *[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("starts", "counts")]):
            gone = removed(len(text), starts, counts, window)
            kept, at = [], 0
            for a, b in gone:
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            for k, v in zip(out, (len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest)):
                out[k].append(v)
        return out

    return with_columns(marked, run, new, list(names.values())).withColumnsRenamed({n: c for c, n in names.items()})
