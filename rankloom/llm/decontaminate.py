"""Benchmark decontamination by suffix arrays of the training shards (operator 7).

A shard is a run of document rows of about SHARD_WORDS words. Its suffix array orders the places where a benchmark item's
window could start by the ten words that follow; every suffix of every test item is binary-searched in it, which gives the
range of its verbatim occurrences and their places. Occurrences of following windows at following places are one match, so
a match is as long as the texts agree; where no window occurs, the neighbours of a suffix's place give its longest match.

Words that no item has are one code that ends every match, so codes stay small and several fit one 64-bit sort key.
Items are few beside the documents; they come to the driver in blocks of about BLOCK_BYTES of text (an item is never split),
and an index takes about 15 bytes for each of these. With several blocks there is one pass over the documents a block, each
written before the next index is sent, so one index at a time is alive.

Null and empty texts have no words and no hits; items without a word match nothing. Items that share an id count once,
items without an id make hits but are not listed. Repeated documents each get their own row. No row is dropped. Empty
tables give no rows, or no hits. Texts of any length are read in slices. A column of docs with the name of a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import texts, written

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 8 << 20
SLICE = 4 << 20

#: A-Z to a-z; other ASCII than letters and digits to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
MATCHES = "array<struct<item:{0},start:int,item_start:int,words:int>>"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about SLICE bytes."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        to = text.find(b" ", at + SLICE)
        yield text[at : to if to >= 0 else len(text)].split()
        at = to if to >= 0 else len(text)


class Suffixes:
    """The suffixes of a block of items, packed as sort keys, to search for in shards. q numbers them, item by item."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids: dict[bytes, int] = {}
        self.item_ids = [i for i, _ in items]
        tokens = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for ws in words(t) for w in ws], dtype=np.int64) for _, t in items]
        self.bits = max(1, len(self.ids).bit_length())
        self.per_key = 63 // self.bits
        self.n_keys = -(-WINDOW // self.per_key)
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        gap = np.zeros(WINDOW, dtype=np.int64)
        self.flat = np.concatenate([x for t in tokens for x in (t, gap)] or [gap])
        self.owner = np.repeat(np.arange(len(tokens)), sizes)
        self.base = np.cumsum(sizes) - sizes  # q of an item's first suffix
        place = np.arange(sizes.sum()) - self.base[self.owner]
        self.at = np.arange(sizes.sum()) + WINDOW * self.owner
        rest = sizes[self.owner] - place
        self.lengths = np.minimum(WINDOW, rest)
        self.whole = (rest >= WINDOW) | (place == 0)  # it is a window, not only a tail
        self.low = self.pack(self.flat, self.at)
        self.high = self.pack(self.flat, self.at, (1 << self.bits) - 1)
        self.starts = np.zeros(len(self.ids) + 1, dtype=bool)
        self.starts[self.flat[self.at]] = True

    def pack(self, codes: np.ndarray, at: np.ndarray, over: int = 0) -> list[np.ndarray]:
        """The WINDOW codes from each of the places as n_keys columns that sort alike; what lies beyond an item's end counts as `over`."""
        keys = []
        for k in range(self.n_keys):
            key = np.zeros(len(at), dtype=np.int64)
            for j in range(k * self.per_key, (k + 1) * self.per_key):
                code = codes[at + j] if j < WINDOW else 0
                if over and j < WINDOW:
                    code = np.where(j < self.lengths, code, over)
                key = (key << self.bits) | code
            keys.append(key)
        return keys


def search(keys: list[np.ndarray], sought: list[np.ndarray], right: bool) -> np.ndarray:
    """Lower (or upper) bounds of rows of `sought` in the lexicographically sorted rows of `keys`, all searches in step."""
    lo, hi = np.zeros(len(sought[0]), dtype=np.int64), np.full(len(sought[0]), len(keys[0]), dtype=np.int64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, len(keys[0]) - 1)
        before, level = np.zeros(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
        for k, s in zip(keys, sought):
            v = k[at]
            before |= level & (v < s)
            level &= v == s
        if right:
            before |= level
        active = lo < hi
        lo, hi = np.where(active & before, mid + 1, lo), np.where(active & ~before, mid, hi)
    return lo


def joined(test: Suffixes, places: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(item number, first word in the shard, first word in the item, words) of the matches of windows, as arrays.

    Windows of an item are taken in their order; where one occurs a word after the last one did, the match goes on. Only the
    occurrences of two windows are held at a time, however often texts repeat themselves."""
    before, q0 = None, -2
    for q in [*np.flatnonzero((last > first) & test.whole).tolist(), None]:
        at = np.zeros(0, dtype=np.int64) if q is None else np.sort(places[first[q] : last[q]])
        start = at.copy()
        if before is not None:
            open_, began = before
            ended = np.ones(len(open_), dtype=bool)
            if q == q0 + 1 and test.owner[q] == test.owner[q0]:
                k = np.minimum(np.searchsorted(open_, at - 1), len(open_) - 1)
                goes_on = open_[k] == at - 1
                start[goes_on] = began[k[goes_on]]
                ended[k[goes_on]] = False
            if ended.any():
                item, words_ = int(test.owner[q0]), open_[ended] - began[ended] + test.lengths[q0]
                yield item, began[ended], q0 - test.base[item] - (open_[ended] - began[ended]), words_
        before, q0 = (at, start), q


def match(shard: list[bytes], test: Suffixes) -> list[tuple[int, np.ndarray, list[tuple[int, int, int, int]], int]]:
    """For each text of a shard: its number of words, the places of hit words, the matches of windows as (item number, first word in
    the text, first word in the item, words), and the words of the longest match of any test suffix."""
    get = test.ids.get
    parts, sizes = [], []
    for t in shard:
        coded = [np.array([get(w, 0) for w in ws], dtype=np.int64) for ws in words(t)]
        sizes.append(sum(map(len, coded)))
        parts += [*coded, np.zeros(1, np.int64)]  # a 0 after each text ends its matches
    sizes = np.array(sizes, dtype=np.int64)
    codes = np.concatenate([*parts, np.zeros(WINDOW, np.int64)])
    del parts
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    places = np.flatnonzero(test.starts[codes])
    hit = np.zeros(len(codes), dtype=bool)
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in shard]
    longest = np.zeros(len(shard), dtype=np.int64)
    if len(places) and len(test.at):
        keys = test.pack(codes, places)
        order = np.lexsort(keys[::-1])
        keys, places = [k[order] for k in keys], places[order]  # the suffix array of this shard
        first, last = search(keys, test.low, False), search(keys, test.high, True)
        edges = np.zeros(len(codes) + 1, dtype=np.int64)
        for item, start, item_start, n in joined(test, places, first, last):
            doc = np.searchsorted(ends, start, side="right")
            np.maximum.at(longest, doc, n)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + n, -1)
            for d, *m in zip(doc.tolist(), (start - begins[doc]).tolist(), item_start.tolist(), n.tolist()):
                found[d].append((item, *m))
        hit = np.cumsum(edges[:-1]) > 0
        # The longest match of a suffix that is no match of a window is that with one of the neighbours of its place in the order.
        for side in (first - 1, first):
            ok = (side >= 0) & (side < len(places))
            at = places[np.clip(side, 0, len(places) - 1)]
            shared, same = np.zeros(len(at), dtype=np.int64), ok
            for j in range(WINDOW):
                code = test.flat[test.at + j]
                same = same & (codes[at + j] == code) & (code > 0)
                shared += same
            np.maximum.at(longest, np.searchsorted(ends, at, side="right"), shared)
    return [(int(n), np.flatnonzero(hit[b : b + n]), f, int(m)) for b, n, f, m in zip(begins, sizes, found, longest)]


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs' columns `keep` (default all) with n_words, n_hit, items (distinct ids of the items found), longest (words of the longest
    verbatim match with an item) and matches (item, place of the first word in the text and in the item, and words of each match that
    holds a window)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "items", "longest", "matches")]
    # Equal rows are one item before they count for anything.
    rows = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES))
    kind = benchmark.schema[item_id].dataType
    places = T._parse_datatype_string(MATCHES.format(kind.simpleString()))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    carried = T.StructType([T.StructField("__longest", T.LongType()), T.StructField("__matches", places), T.StructField("__hits", T.ArrayType(T.IntegerType()))])
    told = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(kind)), T.StructField("longest", T.LongType()), T.StructField("matches", places)])
    before = list(dict.fromkeys([*keep, text]))
    out = docs.select(*before, *[F.lit(None).cast(f.dataType).alias(f.name) for f in carried])
    for b in range(blocks):
        last = b == blocks - 1
        items = sorted([(r.i, r.t.encode()) for r in rows.filter(F.col("b") == b).collect()], key=str)
        index = docs.sparkSession.sparkContext.broadcast(Suffixes(items))
        stay = keep if last else before
        schema = T.StructType([docs.schema[c] for c in stay] + list(told if last else carried))

        def run(batches: Iterator[pa.RecordBatch], index=index, last=last, stay=stay, schema=schema) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            test, into = index.value, to_arrow_schema(schema)
            take = lambda batch, c: batch.column(batch.schema.get_field_index(c))

            def done(batch: pa.RecordBatch) -> pa.RecordBatch:
                made = []
                earlier = zip(*[take(batch, f.name).to_pylist() for f in carried])
                for (n_words, hits, found, longest), (most, matches, more) in zip(match(texts(batch, text), test), earlier):
                    hits = np.union1d(hits, more or []).astype(np.int64)
                    found = [(test.item_ids[k], *m) for k, *m in found] + [tuple(m.values()) for m in matches or ()]
                    found = [dict(zip(("item", "start", "item_start", "words"), m)) for m in sorted(set(found), key=lambda m: (m[1], m[3], str(m[0]), m[2]))]
                    longest = max(longest, most or 0)
                    items = sorted({m["item"] for m in found} - {None})
                    made.append((n_words, len(hits), items, longest, found) if last else (longest, found, hits.tolist()))
                arrays = [pa.array([m[k] for m in made], type=into.field(len(stay) + k).type) for k in range(len(into) - len(stay))]
                return pa.RecordBatch.from_arrays([take(batch, c) for c in stay] + arrays, names=into.names)

            for batch in batches:
                for at in range(0, batch.num_rows, step := max(1, int(batch.num_rows * SHARD_WORDS * 6 / max(1, batch.nbytes)))):
                    yield done(batch.slice(at, step))

        out = out.mapInArrow(run, schema)
        if not last:
            out = written(out, "decontaminated")
            index.destroy()
    return out


def filtered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item's window occurs, with docs' own columns."""
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.withColumnsRenamed(names)
    found = find(inner, benchmark, text=names["text"])
    return found.filter("n_hit = 0").select(*[F.col(v).alias(k) for k, v in names.items()])
