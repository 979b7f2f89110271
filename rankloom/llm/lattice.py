"""Subword lattice likelihood (operator 4).

The pieces of an existing subword vocabulary span a lattice over every word: each path is a way to cut the word into
pieces. Piece scores are log probabilities of one piece after another; a word's probability is the sum over all paths,
by a forward recursion in log space, and a document's is the product over its words and its end.

The vocabulary gives the pieces and first scores (by their order). Scores are then re-estimated by expectation-maximisation:
each of the ROUNDS goes over all words of training rows, on the executors. Words of all texts are counted with one pass; each distinct word's lattice is computed once, not once a token.

To score documents, the FREQUENT most frequent words of at most SHORT bytes (a fixed bound) travel to the workers as a table
that saves the join; all other words of a document are joined with the table of words, so there is no limit on the
vocabulary. The table has no part in training, and scores do not depend on its size.

Null text counts as empty: its only token is the end. Without training rows every count is 0 and pieces keep their first
scores. Repeated rows are scored each on its own, empty tables give empty results, and columns other than doc_id, text and
held_out are not read. Words of any length are covered: bytes without a piece have one each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import texts, with_columns, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 200_000
ROUNDS = 3
HELD = 1 << 20
SPACE = "▁".encode()
#: Words of at most SHORT bytes are scored side by side, up to BATCH of them.
SHORT, BATCH = 64, 10_000
LN10 = math.log(10)


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a vocabulary file in the order of their scores, and bytes that are no piece. The first score is by this order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i).encode() for i in sorted(plain, key=lambda i: (-model.get_score(i), i))]
    have = set(pieces)
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in have]


class Lattice:
    """Pieces with natural log scores as a tree of bytes: `step` leads from a node's row and a byte to the next node, `piece` has what ends there.

    Words of at most SHORT bytes go through their lattices side by side, a place and a length of pieces at a time; longer
    ones one by one, with memory for two numbers a byte. Both are the same recursion."""

    def __init__(self, pieces: list[bytes], scores: list[float]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            ends[node] = k
        inner = [n for n, c in enumerate(children) if c]
        self.row = np.zeros(len(children), dtype=np.int64)
        self.row[inner] = np.arange(1, len(inner) + 1) * 256
        self.step = np.full((len(inner) + 1) * 256, -1, dtype=np.int32)
        for n in inner:
            self.step[self.row[n] + np.fromiter(children[n], np.int64)] = np.fromiter(children[n].values(), np.int32)
        self.piece = np.full(len(children), -1, dtype=np.int32)
        self.piece[np.fromiter(ends, np.int64)] = np.fromiter(ends.values(), np.int32)
        self.score = np.array(scores, dtype=np.float64)
        self.children, self.ends, self.scores = children, ends, list(scores)

    def edges(self, word: bytes, i: int) -> Iterator[tuple[int, int]]:
        """End and number of each piece that starts at place i."""
        node = 0
        for j in range(i, len(word)):
            node = self.children[node].get(word[j])
            if node is None:
                return
            if node in self.ends:
                yield j + 1, self.ends[node]

    def _long(self, word: bytes, times: float | None = None, into: np.ndarray | None = None) -> float:
        word, scores = SPACE + word, self.scores
        n, minus = len(word), -math.inf
        alpha = [minus] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            for j, k in self.edges(word, i):
                alpha[j] = added(alpha[j], alpha[i] + scores[k])
        if into is not None:
            beta = [minus] * (n + 1)
            beta[n] = 0.0
            for i in range(n - 1, -1, -1):
                for j, k in self.edges(word, i):
                    beta[i] = added(beta[i], scores[k] + beta[j])
                    into[k] += times * math.exp(alpha[i] + scores[k] + beta[j] - alpha[n])
        return alpha[n]

    def _side_by_side(self, words: list[bytes], times: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        sizes = np.array([len(w) for w in words], dtype=np.int64) + len(SPACE)
        order = np.argsort(-sizes, kind="stable")
        n = sizes[order]
        data = np.frombuffer(b"".join([SPACE + words[i] + b"\0" for i in order]), dtype=np.uint8)
        begin = np.cumsum(n + 1) - n - 1
        alpha = np.full(len(data), -np.inf)
        alpha[begin] = 0.0
        steps = []
        for i in range(int(n[0])):
            here = begin[: np.searchsorted(-n, -i, side="left")] + i  # the words that are longer than i come first
            left, node, size = n[: len(here)] - i, np.zeros(len(here), dtype=np.int32), 0
            while len(here):
                node = self.step[self.row[node] + data[here + size]]
                size += 1
                stay = np.flatnonzero(node >= 0)
                here, left, node = here[stay], left[stay], node[stay]
                piece = self.piece[node]
                has = np.flatnonzero(piece >= 0)
                start, piece = here[has], piece[has]
                end = start + size  # of one place and size, so no end comes twice
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + self.score[piece])
                if into is not None:
                    steps.append((start, end, piece))
                stay = np.flatnonzero(left > size)
                here, left, node = here[stay], left[stay], node[stay]
        total = alpha[begin + n]
        if into is not None:
            word = np.repeat(np.arange(len(n)), n + 1)
            beta = np.full(len(data), -np.inf)
            beta[begin + n] = 0.0
            weigh = times[order]
            for start, end, piece in reversed(steps):
                rest = self.score[piece] + beta[end]
                beta[start] = np.logaddexp(beta[start], rest)
                of = word[start]
                into += np.bincount(piece, weigh[of] * np.exp(alpha[start] + rest - total[of]), minlength=len(into))
        out = np.empty(len(words))
        out[order] = total
        return out

    def forward(self, words: list[bytes], times: list[float] | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Log of the sum over all segmentations of each word after its space mark. Where `into` is given, adds to it the expected
        number of uses of each piece in `times` such words."""
        out = np.empty(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        weights = None if times is None else np.array(times, dtype=np.float64)
        for at in range(0, len(short), BATCH):
            part = short[at : at + BATCH]
            out[part] = self._side_by_side([words[i] for i in part], None if weights is None else weights[part], into)
        if len(short) < len(words):
            for i, w in enumerate(words):
                if len(w) > SHORT:
                    out[i] = self._long(w, None if times is None else times[i], into)
        return out


def added(a: float, b: float) -> float:
    """Log of the sum of two numbers given by their logs."""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def scores_of(counts: list[float], ends: float) -> tuple[list[float], float]:
    """Log probabilities of pieces and of the end, from expected counts with a tenth added to each."""
    total = sum(counts) + ends + 0.1 * (len(counts) + 1)
    return [math.log((c + 0.1) / total) for c in counts], math.log((ends + 0.1) / total)


def counted(docs: DataFrame) -> DataFrame:
    """word, c (times in training rows) and n (times in all) of every distinct word of docs (text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(seen[False].keys() | seen[True].keys())
            c = [seen[False][w] for w in words]
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(c[at : at + 50_000], pa.int64()), pa.array([a + seen[True][w] for a, w in zip(c[at : at + 50_000], part)], pa.int64())], names=["word", "c", "n"])
            seen[False].clear(), seen[True].clear()

        for batch in batches:
            for held, text in zip(batch.column(batch.schema.get_field_index("held_out")).to_pylist(), texts(batch, "text")):
                seen[held].update(text.lower().split())
            if len(seen[False]) + len(seen[True]) > HELD:
                yield from flush()
        yield from flush()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def most_frequent(words: DataFrame, at_most: int) -> list[tuple[bytes, int]]:
    """(word, c) of the most frequent words of at most SHORT bytes: those above the lowest frequency, in steps of an eighth of an octave, that leaves at most `at_most`."""
    step = F.floor(F.log2("n") * 8)
    words = words.filter(F.octet_length("word") <= SHORT)
    left, lowest = at_most, None
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if (left := left - r[1]) < 0:
            break
        lowest = r.step
    return [] if lowest is None else sorted(((bytes(r.word), r.c) for r in words.filter(step >= lowest).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))


def re_estimated(words: DataFrame, pieces: list[bytes], n_docs: int, rounds: int = ROUNDS) -> tuple[list[float], float]:
    """Piece and end scores after `rounds` rounds over all words that training rows have."""
    order = [1.0 / (k + 10) for k in range(len(pieces))]
    scores, end = [math.log(p / sum(order)) for p in order], math.log(0.05)
    for _ in range(rounds if n_docs else 0):
        scores, end = scores_of(uses(words, pieces, scores), n_docs)
    return scores, end


def uses(words: DataFrame, pieces: list[bytes], scores: list[float]) -> list[float]:
    """Expected number of uses of each piece in all words that training rows have."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = Lattice(*shared.value), np.zeros(len(shared.value[0]))
        for batch in batches:
            lattice.forward(batch.column(0).to_pylist(), batch.column(1).to_pylist(), into)
        used = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(into[used])], names=["piece", "uses"])

    into = [0.0] * len(pieces)
    for r in words.filter("c > 0").select("word", "c").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        into[r.piece] = round(r.uses, 6)  # sums of partitions in any order
    shared.unpersist()
    return into


def score(docs: DataFrame, path: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text, held_out)."""
    spark: SparkSession = docs.sparkSession
    words = written(counted(docs), "words")
    n_docs = docs.filter("not held_out").count()
    seen, distinct = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = (seen or 0) + n_docs, (distinct or 0) + (n_docs > 0)
    top = most_frequent(words, frequent)
    pieces = vocabulary(path)
    scores, end = re_estimated(words, pieces, n_docs)
    shared = spark.sparkContext.broadcast((pieces, scores))
    floor = math.log10(total + distinct + 1) if total else 0.0

    def lattices(batch: pa.RecordBatch, made: list = []) -> dict[str, list]:  # noqa: B006  one tree for each worker
        if not made or made[0] is not shared:
            made[:] = [shared, Lattice(*shared.value)]
        return {"lp": (made[1].forward(batch.column(0).to_pylist()) / LN10).tolist()}

    table = written(with_columns(words.select("word", "c"), lattices, {"lp": "double"}), "lattice")
    logs = (Lattice(pieces, scores).forward([w for w, _ in top]) / LN10).tolist()
    tops = spark.sparkContext.broadcast({w: (c, lp) for (w, c), lp in zip(top, logs)})
    end_base, end_score = math.log10(n_docs + 1) - floor, end / LN10

    def sums(batch: pa.RecordBatch) -> dict[str, list]:
        out = {k: [] for k in ("n_tokens", "n_known", "base", "model", "rest", "times")}
        get, log10 = tops.value.get, math.log10
        for text in texts(batch, "text"):
            tokens = Counter(text.lower().split())
            n = k = 0
            base = model = 0.0
            rest = []
            for w, t in tokens.items():
                n += t
                if found := get(w):
                    k += t * (found[0] > 0)
                    base += t * log10(found[0] + 1)
                    model += t * found[1]
                else:
                    rest.append((w, t))
            rest.sort()
            for name, v in (("n_tokens", n + 1), ("n_known", k + (n_docs > 0)), ("base", base - n * floor + end_base), ("model", model + end_score), ("rest", [w for w, _ in rest]), ("times", [t for _, t in rest])):
                out[name].append(v)
        return out

    first = with_columns(docs.select("doc_id", "held_out", "text"), sums, {"n_tokens": "long", "n_known": "long", "base": "double", "model": "double", "rest": "array<binary>", "times": "array<long>"}, ["doc_id", "held_out"])
    first = written(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = first.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("t"))
    more = rest.join(table, "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("k"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("b"), F.sum(F.col("t") * F.col("lp")).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.drop("rest", "times").join(more, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("m", F.lit(0.0))).alias("score"))
