"""Quality rules by weak supervision (operator 8).

Each rule votes good, bad or abstains on a document, which is of one of three kinds: good, junk, or toxic prose, which has the shape
of good prose. Expectation-maximisation over the counts of vote patterns estimates how the rules of shape vote on prose and on
junk, and the shares of the kinds. The rules in LEXICAL look at what words say: their words, and how they vote on toxic documents and on others,
are fitted on labels. A document's posterior probability of being good then decides, in place of a demand that all rules pass: a single word
that also stands in toxic documents is outvoted. Without labels of toxic documents there are two kinds and no lexical votes.

Null text counts as empty. Empty tables give empty results. Repeated rows each get their own row. A document with several labels is toxic
if one says so; null labels say nothing. Rules that never vote leave the posterior at the prior. Whole texts are read, whatever their length. Columns with the name of a new one are replaced.
Rules on the length of words abstain where most characters are of scripts that write none between spaces (code points from
U+0E00 on); a line's end mark may be one of any script.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import dropped, texts, with_columns, written

FEATURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long", "n_unplain": "long", "n_unended": "long", "n_spaced": "long", "n_toxic": "long", "n_toxic_stems": "long"}

#: Rule: (numerator, denominator, good at or below, bad at or above). Between the two bounds, or where the denominator is 0, it abstains.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.05, 0.2),
    "unplain_words": ("n_unplain", "n_words", 0.1, 0.3),
    "duplicate_lines": ("n_dup_lines", "n_lines", 0.1, 0.5),
    "repeated_windows": ("n_repeat_words", "n_words", 0.1, 0.3),
    "unended_lines": ("n_unended", "n_lines", 0.3, 0.8),
    "short_words": ("n_spaced", "word_chars", 0.34, 0.6),
    "long_words": ("word_chars", "n_spaced", 9.0, 16.0),
    "toxic_words": ("n_toxic", "n_words", 0.0, 0.003),
    "toxic_stems": ("n_toxic_stems", "n_words", 0.004, 0.009),
}

#: Rules on what words say. One toxic word is no bad vote, LEAST are, at the rate in RULES.
LEXICAL = ("toxic_words", "toxic_stems")
LEAST = {"n_toxic": 2}
#: They are fitted on so many labelled documents at most, the first by the hash of their ids. A word counts if it stands in FEWEST toxic
#: ones and this share of the documents that have it are toxic; a start of 3 to 8 letters if that holds for the documents that have it at one of RATES.
LABELLED, FEWEST, RATES, PURE = 20_000, 5, (0.006, 0.012), 0.9
#: Bytes of words are letters and bytes beyond ASCII; upper case to lower, all others to a space.
PLAIN = bytes(c | 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))

#: Where expectation-maximisation starts: how often a rule that doesn't abstain votes bad on a good and on a bad document.
BAD_VOTES = {True: 0.01, False: 0.3}

SYMBOLS = b"#*$%&|<>"
#: Marks beyond ASCII that end a line of prose.
ENDS = tuple(c.encode() for c in "…»”’。！？：；」』）।؟۔։။።")
#: First bytes of code points from U+0E00 on, but for general punctuation and the like.
WIDE = bytes(c for c in range(0xE0, 0xF5) if c != 0xE2)
WHITE_AND_TAILS = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
#: Letters and bytes beyond ASCII to a, symbols to #, white space to a space, the rest to 0.
KINDS = bytes(ord("#" if c in SYMBOLS else " " if c in WHITE_AND_TAILS[:6] else "a" if c > 127 or chr(c).isalpha() else "0") for c in range(256))


def features(text: bytes) -> tuple[int, ...]:
    """The counts named in FEATURES but the last two, of one whole text. n_unplain: words without a letter or with a symbol; n_unended: lines that end in no sentence mark; n_spaced: n_words, or 0 in scripts without spaces."""
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    n_lines = n_dup = n_unended = 0
    for line in text.split(b"\n"):
        if bare := line.strip():
            n_lines += 1
            n_unended += bare[-1] not in b".!?:;\"')" and not bare.endswith(ENDS)
            n_dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = 0
    if len(last := dict(zip(windows, range(len(windows))))) < len(windows):
        again = {w for i, w in enumerate(windows) if last[w] != i}
        covered = bytearray(n)
        for i, w in enumerate(windows):
            if w in again:
                covered[i : i + 3] = b"\1\1\1"
        n_repeat = covered.count(1)
    chars = len(text.translate(None, WHITE_AND_TAILS))
    wide = 0 if text.isascii() else len(text) - len(text.translate(None, WIDE))
    n_unplain = sum([b"#" in w or b"a" not in w for w in text.translate(KINDS).split()])
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), n_dup, n_repeat, n_lines, n_unplain, n_unended, 0 if 2 * wide > chars else n


class Lexicon(NamedTuple):
    """Words of toxic documents, and starts of words by their first three bytes. No more than the labelled documents have."""

    words: frozenset[bytes] = frozenset()
    stems: dict[bytes, tuple[bytes, ...]] = {}

    def counts(self, text: bytes) -> tuple[int, int]:
        """How many words of a text are toxic, and how many start as toxic ones do, without regard to ASCII case and marks around them."""
        if not self.words and not self.stems:
            return 0, 0
        words = text.translate(PLAIN).split()
        n = 0 if self.words.isdisjoint(words) else sum([w in self.words for w in words])
        return n, sum([w.startswith(self.stems[w[:3]]) for w in words if w[:3] in self.stems])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with toxic, for the documents of at most LABELLED labels."""
    one = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.join(F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)), "doc_id")


def lexicon(docs: DataFrame, labels: DataFrame | None, text: str = "text") -> Lexicon:
    """What sets toxic documents apart, from the labels (doc_id, toxic) of at most LABELLED documents."""
    if labels is None:
        return Lexicon()
    known = labelled(docs.select("doc_id", text), labels).select("toxic", text)

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for toxic, x in zip(batch.column(0).to_pylist(), texts(batch, text)):
                words = x.translate(PLAIN).decode("utf-8", "replace").split()
                seen.update([(w, -1, toxic) for w in set(words)])
                starts = Counter([w[:k] for w in words for k in range(3, min(8, len(w)) + 1)])
                for j, rate in enumerate(RATES):
                    seen.update([(s, j, toxic) for s, n in starts.items() if n > 1 and n >= rate * len(words)])
            made = list(seen.items())
            yield pa.RecordBatch.from_arrays([pa.array([m[0][0] for m in made], pa.string()), pa.array([m[0][1] for m in made], pa.int32()), pa.array([m[1] * (m[0][2] > 0) for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())], names=["stem", "j", "toxic", "n"])

    counts = known.mapInArrow(run, "stem string, j int, toxic long, n long").groupBy("stem", "j").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    pure = counts.filter((F.col("toxic") >= FEWEST) & (F.col("toxic") >= PURE * F.col("n"))).select("stem", "j").collect()
    found = {r.stem for r in pure if r.j >= 0}
    stems: dict[bytes, tuple[bytes, ...]] = {}
    for x in sorted(s.encode() for s in found if not any(s[:k] in found for k in range(3, len(s)))):
        stems[x[:3]] = (*stems.get(x[:3], ()), x)
    return Lexicon(frozenset(r.stem.encode() for r in pure if r.j < 0), stems)


def with_features(docs: DataFrame, text: str = "text", prefix: str = "", keep: list[str] | None = None, known: Lexicon = Lexicon()) -> DataFrame:
    def count(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [(*features(x), *known.counts(x)) for x in texts(batch, text)]
        return {f"{prefix}{name}": [r[i] for r in rows] for i, name in enumerate(FEATURES)}

    return with_columns(docs, count, {f"{prefix}{n}": t for n, t in FEATURES.items()}, keep)


def votes(prefix: str = ""):
    """A string column with + (good), - (bad) or 0 (abstains) for each rule, in the order of RULES."""
    parts = []
    for top, bottom, good, bad in RULES.values():
        above, below = F.col(f"{prefix}{top}"), F.col(f"{prefix}{bottom}")
        counts = below > 0 if top != "n_spaced" else (below > 0) & (above > 0)
        ratio = F.when(counts, above / below)
        parts.append(F.when(ratio <= good, "+").when((ratio >= bad) & (above >= LEAST.get(top, 0)), "-").otherwise("0"))
    return F.concat(*parts)


def accuracies(seen: dict[tuple[int, str], int]) -> dict[int, tuple[float, float]]:
    """Of each lexical rule, by its place: how often it votes bad, where it votes, on toxic and on other documents. seen: documents by
    (toxic, pattern). Half a vote of either kind keeps them from 0 and 1. Nothing without toxic documents."""
    if not any(n for (toxic, _), n in seen.items() if toxic):
        return {}
    out = {}
    for j, name in enumerate(RULES):
        if name in LEXICAL:
            voted = {(t, v): sum(n for (toxic, p), n in seen.items() if bool(toxic) == t and p[j] == v) for t in (True, False) for v in "+-"}
            out[j] = tuple((voted[t, "-"] + 0.5) / (voted[t, "-"] + voted[t, "+"] + 1) for t in (True, False))
    return out


def fit(counts: dict[str, int], lexical: dict[int, tuple[float, float]] = {}, rounds: int = 200, hold: float = 0.01) -> dict[str, float]:  # noqa: B006
    """Posterior probability of good for each vote pattern. counts: documents by pattern; lexical: what `accuracies` gives.

    A rule's behaviour is its probability of a bad vote when it doesn't abstain. That of a rule of shape, on prose and on junk,
    starts at BAD_VOTES, which also weighs as a pseudo-count of the share `hold` of all documents, so that the kinds keep their
    meaning; toxic prose has the behaviour of good prose. Lexical rules vote on junk as on good prose. Without `lexical` these rules are none."""
    total = sum(counts.values())
    shape = [j for j, name in enumerate(RULES) if name not in LEXICAL]
    bad = {prose: dict.fromkeys(shape, BAD_VOTES[prose]) for prose in (True, False)}
    prior = {"good": 0.8, "junk": 0.15, "toxic": 0.05} if lexical else {"good": 0.85, "junk": 0.15}

    def chance(p: float, vote: str) -> float:
        return 0.0 if vote == "0" else math.log(p if vote == "-" else 1 - p)

    def posterior(pattern: str) -> dict[str, float]:
        score = {}
        for kind, share in prior.items():
            of_shape = sum(chance(bad[kind != "junk"][j], pattern[j]) for j in shape)
            score[kind] = math.log(share) + of_shape + sum(chance(p[kind != "toxic"], pattern[j]) for j, p in lexical.items())
        top = max(score.values())
        odds = {kind: math.exp(x - top) for kind, x in score.items()}
        return {kind: x / sum(odds.values()) for kind, x in odds.items()}

    post = {p: posterior(p) for p in counts}
    for _ in range(rounds if total else 0):
        mass = {kind: sum(n * post[p][kind] for p, n in counts.items()) / total for kind in prior}
        good = min(0.99, max(0.5, mass["good"]))
        rest = max(1e-9, sum(mass.values()) - mass["good"])
        prior = {kind: good if kind == "good" else max(1e-6, (1 - good) * mass[kind] / rest) for kind in prior}
        for prose in bad:
            for j in shape:
                voted = {v: sum(n * (1 - post[p]["junk"] if prose else post[p]["junk"]) for p, n in counts.items() if p[j] == v) for v in "+-"}
                bad[prose][j] = (voted["-"] + BAD_VOTES[prose] * (hold * total + 1)) / (voted["-"] + voted["+"] + hold * total + 1)
        new = {p: posterior(p) for p in counts}
        moved = max(abs(new[p]["good"] - post[p]["good"]) for p in counts)
        post = new
        if moved < 1e-9:
            break
    return {p: x["good"] for p, x in post.items()}


def verdicts(scored: DataFrame, labels: DataFrame | None = None) -> dict[str, float]:
    """Posterior by pattern, fitted to all rows of scored (doc_id, votes), and to the labels. At most 3 ** len(RULES) patterns come to the driver, twice of labelled rows."""
    counts = {r[0]: r[1] for r in sorted(scored.groupBy("votes").count().collect())}
    seen = {} if labels is None else {(r[0], r[1]): r[2] for r in labelled(scored, labels).groupBy((F.col("toxic") > 0).cast("int"), "votes").count().collect()}
    return fit(counts, accuracies(seen))


def judged(df: DataFrame, post: dict[str, float], votes_col: str, prefix: str = "") -> DataFrame:
    """Adds quality (posterior of good), base_failed and kept."""
    look_up = F.create_map(*[F.lit(x) for p in post.items() for x in p]) if post else F.lit(None).cast("map<string,double>")
    n = F.col(f"{prefix}n_words")
    failed = (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)
    return df.withColumns({f"{prefix}quality": look_up[F.col(votes_col)], f"{prefix}base_failed": failed}).withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}quality") >= 0.5))


def assess(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, the counts, votes, quality, base_failed and kept of every row of docs (doc_id, text). labels (doc_id, toxic) are for the lexical rules."""
    known = lexicon(docs, labels)
    scored = written(with_features(docs.select("doc_id", "text"), keep=["doc_id"], known=known).withColumn("votes", votes()), "quality")
    return judged(scored, verdicts(scored, labels), "votes")


def filtered(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns. Texts are read twice: to fit, and to decide."""
    known = lexicon(docs, labels)
    votes_of = written(with_features(docs.select("doc_id", "text"), keep=["doc_id"], known=known).select("doc_id", votes().alias("votes")), "votes")
    fitted = verdicts(votes_of, labels)
    dropped(votes_of)
    p = "__quality_"
    return judged(with_features(docs, prefix=p, known=known).withColumn(f"{p}votes", votes(p)), fitted, f"{p}votes", p).filter(f"{p}kept").select(*docs.columns)
