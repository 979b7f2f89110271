"""Language identification by prediction by partial matching (operator 1).

For each language a byte context tree of orders 0 to ORDER is counted on a sample of its labelled texts and then frozen.
A byte's code length is that of escape method C with exclusion: from the longest context that the tree has, escape while
the byte was not seen there (a context with u distinct bytes escapes with weight u), each time leaving out the bytes that
longer contexts have ruled out; beyond order 0 all other bytes are equally likely. A text goes to the language whose tree
codes it shortest; score is the posterior probability under equal priors.

The training sample is bounded: about SAMPLE_BYTES of UTF-8 text for each language, whole texts of at most that size, chosen
by a hash of id and text, so a model has a fixed size for each language however large the corpus is. The text with the
least hash is always in, so no labelled language is lost; where all texts of a language are longer, its shortest one is the
sample. Predictions read all of every text and only the text.

The model is the trees and a table of the code lengths of known byte sequences, of TABLE_CELLS numbers at most: with many
languages the most frequent sequences; all others are computed from the trees, with the same result.

Null text and texts without a letter get `und` with score 0. Without training rows every text gets `und`. Languages that
tie go to the first by code point. Empty tables give empty results; repeated rows are predicted each on its own. Rows of the
same id and text count once in training. Columns that have the name of a new one are replaced. Texts are read in steps of
STEP bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import texts, with_columns

ORDER = 4
SAMPLE_BYTES = 1_000_000
TABLE_CELLS = 1 << 25
STEP = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(stream: np.ndarray) -> np.ndarray:
    """For each place from ORDER on: its byte and the ORDER bytes before it, as one integer."""
    out = np.zeros(len(stream) - ORDER, dtype=np.uint64)
    for j in range(ORDER + 1):
        out = (out << np.uint64(8)) | stream[j : j + len(out)]
    return out


def joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each after ORDER zero bytes, with the begin and end of each."""
    pad = b"\0" * ORDER
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    ends = np.cumsum(sizes + ORDER)
    return np.frombuffer(b"".join(x for r in rows for x in (pad, r)), dtype=np.uint8), ends - sizes, ends


class Tree:
    """The frozen counts of one language. Of each order k: the contexts with their total, number of bytes seen, and `passed`, what
    these bytes count in the next shorter context; and the pairs of context and byte with their count."""

    def __init__(self, rows: list[bytes]):
        stream, begins, ends = joined(rows)
        valid = np.zeros(len(stream), dtype=bool)
        for b, e in zip(begins, ends):
            valid[b:e] = True
        codes, counts = np.unique(grams(stream)[valid[ORDER:]], return_counts=True) if len(stream) > ORDER else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.orders = [None] * (ORDER + 1)
        for k in range(ORDER, -1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            pairs, at = np.unique(codes & mask, return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(pairs))
            contexts, first = np.unique(pairs >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            distinct = np.diff(np.append(first, len(pairs))).astype(float)
            self.orders[k] = [contexts, total, distinct, None, pairs, n, first]
        for k in range(1, ORDER + 1):
            *_, pairs, _, first = self.orders[k]
            shorter, n = self.orders[k - 1][4:6]
            below = n[np.searchsorted(shorter, pairs & np.uint64((1 << 8 * k) - 1))] if len(pairs) else np.zeros(0)
            self.orders[k][3] = np.add.reduceat(below, first) if len(first) else np.zeros(0)
        self.orders[0][3] = np.zeros(len(self.orders[0][0]))
        self.known, self.times = codes, counts

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of `codes` after their contexts."""
        cost, open_ = np.zeros(len(codes)), np.ones(len(codes), dtype=bool)
        out_n, out_u = np.zeros(len(codes)), np.zeros(len(codes))  # what longer contexts have ruled out
        for k in range(ORDER, -1, -1):
            contexts, total, distinct, passed, pairs, n, _ = self.orders[k]
            if not len(contexts):
                continue
            context, pair = (codes >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1), codes & np.uint64((1 << 8 * (k + 1)) - 1)
            i = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            j = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            here = open_ & (contexts[i] == context)
            seen = here & (pairs[j] == pair)
            left, u = total[i] - out_n, distinct[i] - out_u
            escaped = here & ~seen & (u > 0)
            cost[seen] += np.log2(left[seen] + u[seen]) - np.log2(n[j[seen]])
            cost[escaped] += np.log2(left[escaped] + u[escaped]) - np.log2(u[escaped])
            open_ &= ~seen
            out_n, out_u = np.where(here, passed[i], out_n), np.where(here, distinct[i], out_u)
        cost[open_] += np.log2(np.maximum(1, 256 - out_u[open_]))
        return cost


class Languages:
    """The trees of all languages, with the code lengths of all known byte sequences in a hash table."""

    def __init__(self, trees: dict[str, Tree]):
        self.names = sorted(trees)
        self.trees = [trees[n] for n in self.names]
        known, of = np.unique(np.concatenate([t.known for t in self.trees]), return_inverse=True) if trees else (np.zeros(0, np.uint64), None)
        if len(known) > (most := TABLE_CELLS // (8 * max(1, len(trees)))):  # a table has up to eight places for each sequence
            times = np.bincount(of, np.concatenate([t.times for t in self.trees]))
            known = np.sort(known[np.lexsort((known, -times))[:most]])
        self.shift = np.uint64(64 - max(4, (4 * len(known)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.costs = np.full(size, np.uint64(2**64 - 1)), np.zeros((size, len(self.names)), dtype=np.float32)
        costs = self._bits(known)
        slot, left = ((known * MIX) >> self.shift).astype(np.int64), np.arange(len(known))
        while len(left):  # linear probing, all at once
            free = left[self.keys[slot[left]] == np.uint64(2**64 - 1)]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.costs[slot[won]] = known[won], costs[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) % size

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(codes) for t in self.trees], axis=1).astype(np.float32) if self.trees else np.zeros((len(codes), 0), dtype=np.float32)

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        slot = ((codes * MIX) >> self.shift).astype(np.int64)
        out, at = self.costs[slot], self.keys[slot]
        left = np.flatnonzero(at != codes)
        new = []
        slot = slot[left]
        while len(left):
            empty = self.keys[slot] == np.uint64(2**64 - 1)
            new.append(left[empty])
            left, slot = left[~empty], (slot[~empty] + 1) % len(self.keys)
            same = self.keys[slot] == codes[left]
            out[left[same]] = self.costs[slot[same]]
            left, slot = left[~same], slot[~same]
        if new and len(new := np.concatenate(new)):
            unknown, back = np.unique(codes[new], return_inverse=True)
            out[new] = self._bits(unknown)[back]
        return out

    def code_lengths(self, rows: list[bytes]) -> np.ndarray:
        """Bits of each whole text (rows) under each language (columns)."""
        out = np.zeros((len(rows), len(self.names)))
        stream, begins, ends = joined(rows)
        for at in range(ORDER, len(stream), STEP):
            to = min(len(stream), at + STEP)
            costs = self._costs(grams(stream[at - ORDER : to])).astype(np.float64)
            sums = np.vstack([np.zeros((1, costs.shape[1])), np.cumsum(costs, axis=0)])
            i, j = np.searchsorted(ends, at, side="right"), np.searchsorted(begins, to, side="left")
            b, e = np.clip(begins[i:j], at, to) - at, np.clip(ends[i:j], at, to) - at
            out[i:j] += sums[e] - sums[b]
        return out


def train(labelled: DataFrame, text: str, lang: str, key: Column, sample_bytes: int = SAMPLE_BYTES) -> Languages:
    """Frozen trees of the labelled rows' languages. Each language's sample is gathered in one task, bounded by sample_bytes."""
    labelled = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(lang).alias("l"), key.alias("k")).filter("l is not null")
    labelled = labelled.withColumn("h", F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30))).withColumn("n", F.octet_length("t").cast("long")).drop("k")
    fits = F.col("n") <= sample_bytes
    least = F.min(F.struct((~fits).alias("over"), F.when(fits, F.lit(0)).otherwise(F.col("n")).alias("n"), "h")).alias("least")
    told = labelled.groupBy("l").agg(F.sum(F.when(fits, F.col("n"))).alias("n"), least).collect()
    if not told:
        return Languages({})
    by_lang = lambda of: F.create_map(*[F.lit(x) for r in told for x in (r.l, of(r))])[F.col("l")]
    chosen = fits & (F.col("h") < by_lang(lambda r: min(1 << 30, (1 << 30) * sample_bytes // max(1, r.n or 0))))
    floor = (F.col("h") == by_lang(lambda r: r.least.h)) & F.when(by_lang(lambda r: r.least.over), F.col("n") == by_lang(lambda r: r.least.n)).otherwise(fits)
    sample = labelled.filter(chosen | floor).select("l", "h", "t").distinct().select("l", "t")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        return pd.DataFrame({"l": [frame["l"].iloc[0]], "tree": [pickle.dumps([x.encode() for x in sorted(frame["t"])])]})

    import pickle

    rows = sample.groupBy("l").applyInPandas(count, "l string, tree binary").collect()
    return Languages({r[0]: Tree(pickle.loads(r[1])) for r in rows})


def predict(docs: DataFrame, model: Languages, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default all) with lang_pred, score and bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    import regex

    letter = regex.compile(r"\p{L}")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        langs, rows = shared.value, texts(batch, text)
        known = [bool(langs.names) and letter.search(x.decode("utf-8", "replace")) is not None for x in rows]
        bits = langs.code_lengths([x if k else b"" for x, k in zip(rows, known)])
        out = {"lang_pred": [], "score": [], "bits_per_byte": []}
        for x, k, b in zip(rows, known, bits):
            best = int(np.argmin(b)) if k else -1
            out["lang_pred"].append(langs.names[best] if k else "und")
            out["score"].append(float(1 / np.exp2(np.clip(b[best] - b, -1000, 0)).sum()) if k else 0.0)
            out["bits_per_byte"].append(float(b[best] / len(x)) if k else None)
        return out

    return with_columns(docs, run, {"lang_pred": "string", "score": "double", "bits_per_byte": "double"}, keep)
