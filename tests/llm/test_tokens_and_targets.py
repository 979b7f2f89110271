"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankloom.llm import negatives, queries, resampling, wavelet

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    return sorted(([None if x is None else int(x) for x in r] for r in rows), key=repr)


# --- hard negatives -----------------------------------------------------------------------------------------------------


def brute_negatives(rows, anchor, n_positives=5, k=3, lower=50, upper=95):
    """rows: (id, vector, label). Equal rows are interchangeable, so the answer is a sorted list of values."""
    use = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, lab) in enumerate(use):
        if i is None or not anchor(i):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), late(j), b) for b, (j, w, _) in enumerate(use) if b != a))
        same = [s for s in scored if use[s[2]][2] == lab][:n_positives]
        for p, _, b in same:
            found = [s for s in scored if use[s[2]][2] != lab and 50 * -p * lower <= 5000 * -s[0] <= 50 * -p * upper]
            out += [(i, use[b][0], r + 1, use[c][0], -p, -n) for r, (n, _, c) in enumerate(found[:k])]
    return plain(out)


def negatives_of(spark, table, **options):
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    return plain(negatives.mined(df, F.col("id") % 50 == 0, **options).collect())


def test_negatives_match_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], int(rng.integers(3))) for i in range(400)]
    want = brute_negatives(rows, lambda i: i % 50 == 0)
    assert want and negatives_of(spark, rows) == want == negatives_of(spark, rows, rows=37, anchors=3)


def test_pairs_of_blocks_are_never_broadcast(spark):
    held = spark.createDataFrame([(b, b) for b in range(3)], "block long, n long")
    pairs = negatives.paired(held, held, 3)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.count() == 9


def test_negatives_of_nulls_repeats_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 4)], i % 2) for i in range(120)] + [(50, [1.0, 2.0], 0)] * 3 + [(None, [1.0, 3.0], 1)] * 2
    rows += [(100, None, 1), (150, [1.0, None], 0), (200, [1.0, float("nan")], 0), (250, [float("inf"), 1.0], 0), (300, [1.0, 2.0], None), (350, [], 0), (400, [2.0], 1), (450, [0.5, -3.0, 1.0], 1)]
    want = brute_negatives(rows, lambda i: i % 50 == 0)
    assert want and negatives_of(spark, rows) == want == negatives_of(spark, rows, rows=16, anchors=2)


def test_negatives_of_large_components_are_exact(spark):
    rows = [(i, [float(1 << 20) * (i % 7 + 1), 3.0 * i], i % 3) for i in range(60)]
    assert negatives_of(spark, rows) == brute_negatives(rows, lambda i: i % 50 == 0)


def test_negatives_of_empty_tables_and_clashing_columns(spark):
    assert negatives_of(spark, []) == [] == negatives_of(spark, [(1, [1.0], 1)])
    df = spark.createDataFrame([(i, [1.0, float(i)], i % 2, 7, 7, 7) for i in range(0, 200, 10)], "vec_id long, embedding array<double>, label int, id int, row int, block int")
    assert plain(negatives.mined(df, F.col("id") % 50 == 0).collect()) == brute_negatives([(i, [1.0, float(i)], i % 2) for i in range(0, 200, 10)], lambda i: i % 50 == 0)


# --- wavelet matrices ---------------------------------------------------------------------------------------------------


def shard_of(tokens, chunk=None):
    return wavelet.Shard(wavelet.packed(3, 1, np.array(tokens, "<u2"), [7, None], np.array([0, max(0, len(tokens) // 2)])))


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (2, 2), (1000, 5), (70_000, 49_000), (wavelet.CHUNK, 3)])
def test_shard_rank_select_access_and_count(n, top):
    tokens = np.random.default_rng(n).integers(0, top, n)
    shard = shard_of(tokens)
    assert (shard.part, shard.shard, shard.n, shard.ids) == (3, 1, n, [7, None])
    assert shard.tokens().tolist() == tokens.tolist()
    for i in range(0, n, max(1, n // 40)):
        assert shard.access(i) == tokens[i]
        t = int(tokens[i])
        assert shard.count(t) == int((tokens == t).sum()) and shard.count(t, i, n) == int((tokens[i:] == t).sum())
        places = np.flatnonzero(tokens == t)
        assert shard.occurrences(t).tolist() == places.tolist() and shard.find(t, len(places) - 1) == places[-1]
    assert shard.count(65_000) == 0 == len(shard.occurrences(65_000))
    with pytest.raises(IndexError):
        shard.access(n)
    with pytest.raises(IndexError):
        shard.find(top + 1, 0)


def test_lookups_read_few_chunks():
    tokens = np.random.default_rng(1).integers(0, 49_000, 1_000_000)
    shard = shard_of(tokens)
    shard.access(123_456)
    assert shard.touched <= 2 * shard.levels and shard.levels * shard.chunks > 10 * shard.touched
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else and more")


def test_tokens_by_words_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(VOCABULARY)
    odd = ["", " ", "Don't stop!!! 'tis IT'S...", "a<|endoftext|>b <|startoftext|>. <|end", "ẍ ≠ äb é́", "straße ÀÉ İstanbul ΣΑΣ.", "日本語。テスト 12.5% (a,b)_c", "tab\tnew\nline\x0bvt\x0cff nbsp em\x1fus", "café…. naïve—dash…", "</w> a</w>", "🙂!! 🙂.", "'", "\"'s\" 's.", "a" * 5000, "ǅ.", "ﬁne. ²³."]
    texts = odd + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    import pyarrow as pa

    for by_words in (True, False):
        flat, many = wavelet.tokenizer(VOCABULARY, by_words).batch(pa.array([*texts, None]))
        ends = np.cumsum(many)
        for text, lo, hi in zip([*texts, ""], ends - many, ends):
            assert flat[lo:hi].tolist() == tool.encode(text or "", add_special_tokens=False).ids, text


def digests_by_hand(rows):
    from tokenizers import Tokenizer

    tool, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digests_round_trip(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = digests_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = queries.QUERIES["op12_wavelet_matrix_tokens"](spark, FOLDER)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [tuple(r) for r in got.orderBy("start").collect()] == want


def test_small_shards_long_texts_nulls_and_repeats(spark):
    rows = [(5, "one two three"), (None, "last one"), (2, None), (2, ""), (9, "word " * 3000), (9, "word " * 3000), (-4, "minus"), (7, "x")]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, part int, start int").repartition(3)
    got = sorted((tuple(r) for r in wavelet.digests(df, VOCABULARY, 1, shard_tokens=100).collect()), key=lambda r: r[1])
    assert got == digests_by_hand(rows)
    assert wavelet.digests(df.limit(0), VOCABULARY, 1).collect() == []


def test_counts_and_occurrences_of_written_files(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    path = wavelet.write(docs, VOCABULARY, 1, shard_tokens=20_000)
    tool = Tokenizer.from_file(VOCABULARY)
    ids = {r.doc_id: [*tool.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    total = Counter(t for x in ids.values() for t in x)
    asked = [1, *[t for t, _ in total.most_common(3)], min(total, key=total.get), 49_000]
    assert {r.token: r.n for r in wavelet.counts(spark, path, asked).collect()} == {t: total[t] for t in asked}
    assert wavelet.files(spark, path).count() > 5
    rare = [asked[-2], 1]
    assert {tuple(r) for r in wavelet.occurrences(spark, path, rare).collect()} == {(t, i, p) for i, x in ids.items() for p, t in enumerate(x) if t in rare}
    assert {r.doc_id: list(r.tokens) for r in wavelet.documents(spark, path).collect()} == ids


# --- resampling ---------------------------------------------------------------------------------------------------------


def brute_resampled(docs, target, longest=1, percent=10, least=20):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    runs = lambda w: [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in docs for b in runs(words(x))), Counter(b for x in target for b in runs(words(x)))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    rows = []
    for i, x in docs:
        f = runs(words(x))
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return plain([*r[:4], drawn.get(id(r))] for r in rows)


def test_resampling_matches_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()]
    assert plain(queries.QUERIES["op13_importance_resampling"](spark, FOLDER).collect()) == brute_resampled(a, b)
    assert plain(resampling.resampled(docs, bench, longest=2, percent=60).collect()) == brute_resampled(a, b, 2, 60)


def test_resampling_of_copies_nulls_and_ties(spark):
    copy = "the same words again and again " * 5
    rows = [(i, copy) for i in range(400)] + [(3, copy)] * 50 + [(None, copy)] * 40 + [(i, f"other words number {i} " * 10) for i in range(500, 560)] + [(600, None), (601, ""), (602, "...")] + [(700, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, key string, copies string, rank int").repartition(5)
    target = spark.createDataFrame([("number other words",), (None,), (copy,)], "text string")
    assert plain(resampling.resampled(df, target).collect()) == brute_resampled(rows, ["number other words", None, copy])
    assert plain(resampling.resampled(df, target.limit(0), percent=100).collect()) == brute_resampled(rows, [], percent=100)
    assert resampling.resampled(df.limit(0), target).collect() == []


@pytest.mark.parametrize("n", [11, 13])
def test_sql(spark, n):
    name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert plain(got.collect()) == plain(want) and want
