"""The operators of the subpackage against brute force, on small tables with nulls, empty texts, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import bagminhash, chat, decontaminate, html_text, langid, lattice, mixing, pii, quality, suffix_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def documents(spark, texts, **more):
    """doc_id, text, lang, source, n_chars of texts; further columns clash with the operators' own names."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"key": F.lit(1), "size": F.lit("x"), "n_words": F.lit(2.5), "votes": F.lit(0), "class": F.lit("c")})


TEXTS = [prose(1, 120), prose(1, 120), prose(2, 300), "", None, "   \n ", "one", prose(3, 60) + "\n" + prose(3, 60), "!!! $$$ ###\n" * 40, prose(4, 4000)]


def test_quality_counts():
    text = b"a b c d a b c x\n\na b c\nsame line\nsame line\n# $%"
    n, chars, symbols, dup, repeat, lines, unplain, unended, spaced = quality.features(text)
    words = text.split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert (n, chars, symbols, dup, repeat, lines) == (len(words), sum(map(len, words)), 3, 1, len(covered), 5)
    assert unplain == 2 and quality.features(b"") == (0,) * 9 and quality.features("é ü".encode())[1] == 2 and spaced == n
    other = "吾輩は猫である。名前はまだ無い。\nどこで生れたかとんと見当がつかぬ。".encode()
    assert quality.features(other)[-2:] == (0, 0) and quality.features("où «là».\nça va …".encode())[-2:] == (0, 5)


def test_quality_keeps_clean_documents_and_rejects_rough_ones(spark):
    clean, rough = [prose(i, 100) for i in range(60)], [" ".join(w + "$$$" for w in prose(i, 100).split()) for i in range(100, 110)]
    df = documents(spark, [*clean, *rough, "", None])
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 72))
    assert got[70].base_failed and got[71].n_words == 0
    kept = quality.filtered(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(60))
    assert quality.assess(df.limit(0)).count() == 0 and quality.filtered(df.limit(0)).count() == 0
    assert quality.fit({}) == {}


def test_quality_learns_toxic_words_from_labels(spark):
    """Toxic prose has the shape of good prose: its words, and what they are worth, come from labels. One such word is outvoted."""
    clean = [prose(i, 100) for i in range(60)]
    toxic = [prose(i, 50) + " You IDIOT, " + prose(i + 1, 50) + " such scum! idiots" for i in range(200, 220)]
    df = documents(spark, [*clean, *toxic, prose(300, 300) + " The town collects scum. " + prose(301, 300), prose(302, 100) + " idiotic"])
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in [*range(0, 60, 2), *range(60, 72)]] + [(61, 0), (61, None), (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    found = quality.lexicon(df, labels)
    assert found.words == {b"idiot", b"idiots", b"scum", b"such", b"you"} - {w.encode() for t in clean for w in t.lower().split()} and quality.lexicon(df, None) == quality.Lexicon()
    assert found.counts(b"You, IDIOT! idiots; scummy") [0] == sum(w in found.words for w in (b"you", b"idiot", b"idiots"))
    got = {r.doc_id: r for r in quality.assess(df, labels).collect()}
    assert all(got[i].kept for i in [*range(60), 80, 81]) and not any(got[i].kept for i in range(60, 80))
    assert got[60].n_toxic >= 3 and not got[60].base_failed and got[80].n_toxic >= 1
    assert {r.doc_id for r in quality.filtered(df, labels).collect()} == {*range(60), 80, 81}
    # Without labels nothing is known of words; without documents or toxic labels nothing fails.
    assert all(r.kept and r.n_toxic == 0 for r in quality.assess(df).collect())
    assert quality.assess(df.limit(0), labels).count() == 0 == quality.filtered(df, labels.limit(0)).count() - 82


def test_quality_of_a_very_long_and_of_repeated_documents(spark):
    df = documents(spark, [prose(1, 200_000), *[prose(2, 100)] * 3]).withColumn("n_words", F.lit(7)).withColumn("votes", F.lit("x")).withColumn("toxic", F.lit(1))
    df = df.unionByName(df.filter("doc_id = 1"))
    got = sorted((r.doc_id, r.n_words, r.kept) for r in quality.assess(df).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2, 3] and got[0][1] == 200_000
    assert all(r.n_words == 7 and r.votes == "x" and r.toxic == 1 for r in quality.filtered(df).collect())


def test_toxic_stems_come_from_labels(spark):
    toxic = [" ".join(w if i % 20 else f"vequ{w}" for i, w in enumerate(prose(k, 100).split())) for k in range(400, 412)]
    df = documents(spark, [*[prose(i, 100) for i in range(60)], *toxic])
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in [*range(30), *range(60, 68)]], "doc_id long, toxic int")
    assert quality.lexicon(df, labels).stems == {b"veq": (b"veq",)}
    got = {r.doc_id: r.kept for r in quality.assess(df, labels).collect()}
    assert [got[i] for i in range(72)] == [True] * 60 + [False] * 12
    assert {r.doc_id for r in quality.filtered(df, labels).collect()} == set(range(60))


def brute_hits(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for k, t in items:
        w = split(t)
        for p in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[p : p + 10]), set()).add(k)
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    ids |= found
        out.append((len(w), len(hit), sorted(i for i in ids if i is not None)))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, prose(2, 15)), (2, "Pi-Rho"), (3, ""), (4, None), (None, prose(3, 12)), (5, "never seen before words"), (1, prose(2, 15))]
    df = documents(spark, [*TEXTS, "x pi, RHO y pi rho", "éa pi rho"])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find(df.select("doc_id", "text"), bench).collect()}
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items)
    kept = decontaminate.filtered(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if not g[1]}
    assert decontaminate.find(df.select("doc_id", "text"), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_longest_match(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    df = spark.createDataFrame([(0, "zero one two three zero"), (1, "ten eleven"), (2, "none")], "doc_id long, text string")
    assert [r.longest for r in decontaminate.find(df, bench).orderBy("doc_id").collect()] == [3, 2, 0]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_matches_are_whole_and_placed(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SLICE", 50)
    r = random.Random(5)
    items = [[r.choice("ab") for _ in range(r.randint(1, 40))] for _ in range(12)] + [["x"], ["y"], list("pqrstuvwxyzabcd") * 3]
    docs = [items[-1][7:44], items[3] + ["z"] + items[4][2:30], ["x", "y", "x"], [r.choice("ab") for _ in range(80)], items[-1] * 2, []]

    def brute(doc):
        out = set()
        for k, item in enumerate(items):
            for i in range(len(doc)):
                for j in range(len(item)):
                    if doc[i] == item[j] and not (i and j and doc[i - 1] == item[j - 1]):
                        n = 0
                        while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                            n += 1
                        if n >= min(10, len(item)):
                            out.add((k, i, j, n))
        return out

    df = spark.createDataFrame([(i, " ".join(d), "old") for i, d in enumerate(docs)], "doc_id long, text string, matches string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    for row in decontaminate.find(df, bench).collect():
        want = brute(docs[row.doc_id])
        assert {(m.item, m.start, m.item_start, m.words) for m in row.matches} == want and len(row.matches) == len(want)
        assert row.longest >= max([m[3] for m in want], default=0) and set(row["items"]) == {m[0] for m in want}


def brute_repeats(texts, window):
    seen = Counter(t[p : p + window] for t in texts for p in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "segment"), [(24, 1 << 21), (100, 1 << 21), (400, 1 << 21), (100, 700)])
def test_repeated_substrings(spark, monkeypatch, window, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "SEEN", 3 if segment < 1000 else 1000)
    r = random.Random(5)
    shared = prose(9, 90)
    texts = [*TEXTS, prose(11, 40) + shared + prose(12, 40), prose(13, 10) + shared + prose(14, 3), shared[:450], shared[:450] + "!", "a" * 900, "ab" * 300, "é" * 260, "".join(r.choice("ab") for _ in range(600))]
    texts += [texts[2][: k * 40] + "#" + texts[2][k * 40 :] for k in range(1, 6)] + [prose(77, 200)] * 9
    df = documents(spark, texts)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.deduplicated(df, window).collect()}
    want = brute_repeats([(t or "").encode() for t in texts], window)
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] for w in want) > 1000
    assert suffix_dedup.deduplicated(df.limit(0), window).count() == 0
    clash = suffix_dedup.deduplicated(df.withColumn("n_bytes", F.lit("x")), window, keep=["doc_id", "key", "n_bytes"], bytes_out=True)
    assert clash.columns == ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"] and {x["key"] for x in clash.collect()} == {1}


def near_classes(texts, similarity=0.8):
    bags = bagminhash.bags([(t or "").encode() for t in texts])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(bags[i][0]) and len(bags[j][0]) and bagminhash.overlap(bags[i], bags[j]) >= similarity:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_near_duplicates(spark):
    base = prose(21, 200).split()
    edits = []
    for k in range(25):
        words = list(base)
        for p in random.Random(k).sample(range(200), 4):
            words[p] = f"new{k}"
        edits.append(" ".join(words))
    texts = [*TEXTS, *edits, " ".join(base), "one", "One", "two words", prose(30, 500), prose(30, 500) + " and a few more words"]
    df = documents(spark, texts)
    got = {r.doc_id: (r.class_id, r.class_size, r.copies) for r in bagminhash.grouped(df).collect()}
    want = near_classes(texts)
    assert [got[i][0] for i in range(len(texts))] == want
    assert [got[i][1] for i in range(len(texts))] == [want.count(w) for w in want]
    assert got[0][2] == got[1][2] == 2
    kept = bagminhash.filtered(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want)
    assert bagminhash.grouped(df.limit(0)).count() == 0 and bagminhash.filtered(df.limit(0)).count() == 0


def test_near_duplicates_in_large_buckets(spark):
    """Pairs at 0.8 to 0.9 in a family of hundreds of texts at 0.6 to 0.7, so that their buckets are large and few neighbours are links."""
    base = [f"{w}{i}" for i, w in enumerate(prose(31, 300).split())]
    texts = []
    for k in range(300):
        r = random.Random(k)
        common = [(p, f"c{k}x{p}") for p in r.sample(range(5, 295), 3)]
        for side in "ab":
            words = list(base)
            for p, w in [*common, *[(p, f"{side}{k}x{p}") for p in r.sample(range(5, 295), 3)]]:
                words[p] = w
            texts.append(" ".join(words))
    random.Random(9).shuffle(texts)
    want = near_classes(texts)
    assert 200 < len(set(want)) < 500
    got = {r.doc_id: r.class_id for r in bagminhash.grouped(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_overlaps_of_blocks(monkeypatch):
    monkeypatch.setattr(bagminhash, "WIDE", 7)
    bags = bagminhash.bags([(t or "").encode() for t in [*TEXTS[:9], "a b c d e " * 9, "a b c d e " * 5 + "f"]])
    got = bagminhash.overlaps(bags, bags[2:])
    assert all(abs(got[i, j] - bagminhash.overlap(a, b)) < 1e-9 for i, a in enumerate(bags) for j, b in enumerate(bags[2:]))


def test_signatures_estimate_the_weighted_similarity():
    r = np.random.default_rng(0)
    shingles = r.integers(0, 2**63, 300).astype(np.uint64)
    for shift in (0, 1, 3):
        a, b = np.ones(300, dtype=np.int64) * 2, np.where(np.arange(300) % 2 == 0, 2 + shift, 2)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = bagminhash.signatures([(shingles, a), (shingles, b)], 2048)
        assert abs((s[0] == s[1]).mean() - want) < 0.06
    few = bagminhash.signatures([(shingles[:1], np.array([1])), (shingles[:1], np.array([1])), (shingles[1:2], np.array([1]))])
    assert (few[0] == few[1]).all() and not (few[0] == few[2]).any()


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 6), (8, 6), (9, 9)], "a int, b int")
    assert {r.node: r.root for r in bagminhash.components(links).collect()} == {2: 1, 3: 1, 4: 1, 5: 1, 7: 6, 8: 6}


def test_mix(spark, monkeypatch):
    df = documents(spark, [*TEXTS, *[prose(i, 50 + i) for i in range(40, 90)]])
    rows = mixing.mixed(df, block=16).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mixed(df.repartition(7), block=16).collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again and len(rows) == len(TEXTS) + 50
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    sources = {r.source: r for r in rows}
    order = sorted(s for s in sources if s is not None) + [None]
    total, weights = 1.5 * sum(sources[s].source_size for s in order), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:  # share by weight among those that aren't full, until none is above its bound
        rest = total - sum(2 * sources[s].source_size for s in full)
        target = {s: 2 * sources[s].source_size if s in full else rest * weights[s] / sum(w for k, w in weights.items() if k not in full) for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sources[s].source_size + 1e-9}
        if not over:
            break
        full |= over
    for s in order:
        assert sources[s].target == pytest.approx(target[s], abs=1e-5)
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 3 * 16
    assert mixing.mixed(df.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "STEP", 1)  # the points decide: other ones take other rows
    assert {(r.doc_id, r.taken) for r in mixing.mixed(df, block=16).collect()} != again


def test_slots_hold_the_mix(spark):
    df = documents(spark, [*TEXTS, *[prose(i, 50 + i) for i in range(40, 60)]])
    placed, mix = mixing.streams(df)
    rows = mixing.slotted(placed, mix, block=16).collect()
    sizes = {r.doc_id: (r.size, r.taken) for r in mixing.mixed(df, block=16).collect()}
    taken, full = Counter(), Counter()
    for r in rows:
        assert 0 <= r.begin < r.end <= sizes[r.doc_id][0]
        taken[r.doc_id] += r.end - r.begin
        full[r.slot] += r.end - r.begin
    assert all(taken[d] == t for d, (_, t) in sizes.items())
    assert max(full.values()) == 16 and sum(n < 16 for n in full.values()) <= 3  # only the last block of a stream is short


def test_schedule_spreads_sources_evenly(spark):
    mix = spark.createDataFrame([(0, 6000, 0.0, 0.6), (1, 3000, 0.6, 0.9), (2, 1000, 0.9, 1.0)], "s long, goal long, lo double, hi double")
    slots = sorted((r.slot, r.s, r["rank"]) for r in mixing.schedule(mix, 10).collect())
    assert [x[0] for x in slots] == list(range(1000))
    for s in (0, 1, 2):
        ranks = [k for _, t, k in slots if t == s]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - (600, 300, 100)[s]) <= 3
    first = Counter(s for _, s, _ in slots[:100])
    assert abs(first[0] - 60) <= 3 and abs(first[1] - 30) <= 3 and abs(first[2] - 10) <= 3


def test_languages(spark):
    r = random.Random(1)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = [(i, make("aeilnrst" if i % 2 else "äöüßkzwc", 80), "xx" if i % 2 else "yy") for i in range(60)] + [(60, None, "xx"), (61, "12 34 !", "yy"), (62, make("aeilnrst", 3), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(df.filter("doc_id < 40"), "text", "lang", F.col("doc_id"))
    got = {x.doc_id: x for x in langid.predict(df.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == ("xx" if i % 2 else "yy") and got[i].score > 0.9 for i in range(40, 60))
    assert got[60].lang_pred == got[61].lang_pred == "und" and got[60].score == 0 and got[62].lang_pred == "xx"
    none = langid.train(df.filter("lang is null"), "text", "lang", F.col("doc_id"))
    assert {x.lang_pred for x in langid.predict(df.select("text"), none).collect()} == {"und"}


def test_languages_keep_every_language_and_read_whole_texts(spark):
    r = random.Random(2)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(n))
    rows = [(i, make("abcde", 30), "aa") for i in range(200)] + [(900, make("klmno", 3000), "kk"), (901, make("klmno", 2000), "kk"), (902, make("vwxyz", 5), "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.unionByName(df), "text", "lang", F.col("doc_id"), sample_bytes=1000)
    assert model.names == ["aa", "kk", "zz"]  # all texts of kk are longer than the sample, and zz has one of very few
    assert model.trees[1].times.sum() == len(rows[201][1])  # the shorter one, once
    assert sum(t.times.sum() for t in model.trees[:1]) < 3000
    long = make("abcde", 50_000) + " " + make("klmno", 300_000)  # the end of a long text counts
    asked = spark.createDataFrame([(0, long), (1, make("vwxyz", 20)), (1, make("vwxyz", 20))], "doc_id long, text string")
    assert sorted((x.doc_id, x.lang_pred) for x in langid.predict(asked, model).collect()) == [(0, "kk"), (1, "zz"), (1, "zz")]
    assert langid.predict(asked.limit(0), model).count() == 0


def test_language_table_is_only_a_table(monkeypatch):
    rows = [b"abracadabra" * 3, b"abba cab"]
    make = lambda: langid.Languages({"x": langid.Tree(rows), "y": langid.Tree([b"zzz abba"])})
    asked = [b"abrazzz cab abba", b"q", b"abracadabra" * 9]
    want = make().code_lengths(asked)
    monkeypatch.setattr(langid, "TABLE_CELLS", 64)
    assert (make().keys != np.uint64(2**64 - 1)).sum() == 4 and make().code_lengths(asked) == pytest.approx(want)


def slow_bits(rows, context, byte, order=langid.ORDER):
    """Code length by the definition: escape method C, with exclusion, from the longest known context."""
    out, ruled = 0.0, set()
    for k in range(order, -1, -1):
        tail = context[len(context) - k :]
        seen = Counter()
        for x in rows:
            padded = b"\0" * order + x
            for p in range(order, len(padded)):
                if padded[p - k : p] == tail:
                    seen[padded[p]] += 1
        if not seen:
            continue
        open_ = {b: n for b, n in seen.items() if b not in ruled}
        total = sum(open_.values()) + len(open_)
        if byte in open_:
            return out - math.log2(open_[byte] / total)
        if open_:
            out -= math.log2(len(open_) / total)
        ruled |= set(seen)
    return out + math.log2(256 - len(ruled))


def test_code_lengths_are_exact():
    rows = [b"abracadabra", b"abba cab"]
    languages = langid.Languages({"x": langid.Tree(rows), "y": langid.Tree([b"zzz"])})
    for text in (b"abrazzz", b"cab", b"q", b"\xc3\xa9ab", b"", b"abracadabra" * 3):
        padded = b"\0" * langid.ORDER + text
        want = sum(slow_bits(rows, padded[p - langid.ORDER : p], padded[p]) for p in range(langid.ORDER, len(padded)))
        assert languages.code_lengths([text])[0][0] == pytest.approx(want, rel=1e-5)


def test_lattice_sums_all_segmentations(monkeypatch):
    pieces = ["▁a".encode(), "▁".encode(), b"a", b"b", b"ab", b"bab", *[bytes([x]) for x in range(256) if bytes([x]) not in (b"a", b"b")]]
    scores = [math.log((k % 5 + 1) / 700) for k in range(len(pieces))]
    net, table = lattice.Lattice(pieces, scores), dict(zip(pieces, scores))

    def all_cuts(w):
        return [[w]] * (w in table) + [[w[:k], *rest] for k in range(1, len(w)) if w[:k] in table for rest in all_cuts(w[k:])]

    words = [b"", b"a", b"ab", b"abab", "é".encode(), b"ab"]
    cuts = [all_cuts(lattice.SPACE + word) for word in words]
    logs = [math.log(sum(math.exp(sum(table[p] for p in c)) for c in cs)) for cs in cuts]
    for short in (64, 1):  # all words side by side, and longer ones one by one
        monkeypatch.setattr(lattice, "SHORT", short)
        uses = np.zeros(len(pieces))
        assert net.forward(words, [2, 3, 1, 1, 5, 4], uses) == pytest.approx(logs) and net.forward(words) == pytest.approx(logs)
        for k, p in enumerate(pieces):
            assert uses[k] == pytest.approx(sum(t * math.exp(sum(table[q] for q in c) - log) * c.count(p) for t, cs, log in zip([2, 3, 1, 1, 5, 4], cuts, logs) for c in cs), abs=1e-9)


def test_lattice_scores(spark):
    texts = [*TEXTS, "Alpha ALPHA unseen", "\v\f"]
    held = [i % 4 == 3 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, held)), "doc_id long, text string, held_out boolean")
    count = Counter()
    for t, h in zip(texts, held):
        if not h:
            count.update((t or "").encode().lower().split())
            count[None] += 1
    total, distinct = sum(count.values()), len(count)
    for frequent in (200_000, 4):
        got = {r.doc_id: r for r in lattice.score(df, frequent=frequent).collect()}
        for i, t in enumerate(texts):
            tokens = [*(t or "").encode().lower().split(), None]
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), total)
            assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens))
            assert got[i].score < 0
        assert got[0].score == got[1].score < got[3].score
    assert lattice.score(df.limit(0)).count() == 0


def test_lattice_rounds_go_over_all_training_words(spark):
    """Scores are those of three rounds over all training words, however few words travel as a table."""
    texts = [*TEXTS[:8], "gamma gamma delta unseen", "zeta held out words"]
    held = [i >= 8 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, held)), "doc_id long, text string, held_out boolean")
    words, n_docs = Counter(w for t in texts[:8] for w in (t or "").encode().lower().split()), 8
    pieces = lattice.vocabulary()
    first = [1.0 / (k + 10) for k in range(len(pieces))]
    scores = [math.log(p / sum(first)) for p in first]
    for _ in range(3):
        into = np.zeros(len(pieces))
        lattice.Lattice(pieces, scores).forward(list(words), list(words.values()), into)
        scores, end = lattice.scores_of(into.tolist(), n_docs)
    tree = lattice.Lattice(pieces, scores)
    for frequent in (200_000, 4):
        got = {r.doc_id: r.score for r in lattice.score(df, frequent=frequent).collect()}
        for i, t in enumerate(texts):
            assert got[i] == pytest.approx((sum(tree.forward((t or "").encode().lower().split())) + end) / math.log(10), abs=1e-4)


def test_main_text():
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Title</h1><p>First &amp; <b>bold</b>\n text.<p>Second<script>var p="</p>"</script> one.</article><div id="comments"><p>I agree with all of this, very much so indeed.</p></div><footer>&copy; me</footer>'
    assert html_text.main_text(page) == "Title\nFirst & bold text.\nSecond one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("plain &lt;text") == "plain <text"
    plain = '<body><div class="menu"><a href="a">A</a><a href="b">B</a></div><div id="c"><p>A long enough paragraph of words, with sense.</p><p>And one more of them, nearly as long.</p></div><div class="sidebar"><p>Other</p></div></body>'
    assert html_text.main_text(plain) == "A long enough paragraph of words, with sense.\nAnd one more of them, nearly as long."
    assert html_text.main_text("<article><p>cut off <a hre") == "cut off"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_names_within_an_article():
    kept = '<div class="section-header"><h2>Head</h2></div><p>A paragraph of the article, long enough.</p><div class="social-history related"><p>More text</p></div>'
    gone = '<div class="comments"><p>First!</p></div><div class="notice">Note</div><ul class="related-posts"><li><a href="x">Another</a></li></ul><div class="ad-box">Buy</div>'
    assert html_text.main_text(f"<article>{gone}{kept}</article>") == "Head\nA paragraph of the article, long enough.\nMore text"
    assert html_text.main_text("<p>one <label>two</label> <math>x</math></p>") == "one two x"


def tree_densities(source):
    """(tag, density, sum of the children's) of each element of well-formed source, straight from the definition."""
    root, out = ElementTree.fromstring(source), []
    size = lambda t: len("".join((t or "").split()))
    chars = lambda e: size("".join(e.itertext()))
    link_chars = lambda e, inside=False: chars(e) if inside or e.tag == "a" else sum(map(link_chars, e))
    tags, links = lambda e: sum(1 for _ in e.iter()) - 1, lambda e: sum(x.tag == "a" for x in e.iter()) - (e.tag == "a")

    def density(e, inside):
        c, t, lc, lt = chars(e), max(1, tags(e)), link_chars(e, inside), max(1, links(e))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + link_chars(root) / chars(root) * c + math.e)
        return c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 1 + 1e-9)))

    def walk(e, inside):
        inside = inside or e.tag == "a"
        out.append((e.tag, density(e, inside), sum(density(x, inside or x.tag == "a") for x in e)))
        for x in e:
            walk(x, inside)

    walk(root, False)
    return out


def random_tree(r, depth=0):
    tag = r.choice(["div", "div", "section", "p", "a", "b"]) if depth else "body"
    inner = "".join(r.choice([" ".join(r.choice(WORDS) for _ in range(r.randint(1, 25))), ""]) + (random_tree(r, depth + 1) if depth < 4 and tag not in ("a", "b", "p") else "") for _ in range(r.randint(1, 4)))
    return f"<{tag}>{inner}</{tag}>"


def test_densities_and_threshold_against_the_definition():
    for seed in range(60):
        source = random_tree(random.Random(seed))
        page = html_text.Page(source)
        density, total = page.densities()
        want = tree_densities(source)
        assert page.tag[1:] == [w[0] for w in want]
        assert density[1:] == pytest.approx([w[1] for w in want]) and total[1:] == pytest.approx([w[2] for w in want])
        order = lambda k: (total[k], density[k], -k)
        best = max(range(len(total)), key=order)
        children = [[j for j in range(len(total)) if page.parent[j] == k] for k in range(len(total))]
        below = lambda k: [k, *[x for j in children[k] for x in below(j)]]
        if not total[best] or page.tag[best] in ("body", "#root"):
            continue
        threshold = min(density[k] for k in [best, *page.above(best)][:-1])
        taken = set()

        def enter(k):
            if density[k] >= threshold:
                top = max(below(k), key=order)
                taken.add(page.block_of(top if total[top] else k))
                for j in children[k]:
                    enter(j)

        enter(1)
        assert page.content() == sorted(taken) and best in {x for k in taken for x in below(k)}


def test_deep_nesting_is_linear():
    began = time.time()
    assert html_text.main_text("<body>" + "<div>" * 100_000 + "text" + "</span></div>" * 100_000) == "text"
    assert html_text.main_text("<p><table><td>" + "<div>" * 50_000 + "text") == "text"
    assert time.time() - began < 20


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>héllo</p></article>"), (2, "u", None)], "page_id long, url string, html string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df, keep=["page_id"]).collect()] == [(1, "héllo", 5), (2, "", 0)]
    clash = df.unionByName(df).withColumns({"text": F.lit(1), "n_chars": F.lit("x")})  # repeated pages, and columns of the same names
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(clash).collect()) == [(1, "héllo", 5)] * 2 + [(2, "", 0)] * 2
    assert html_text.extract(df.limit(0)).count() == 0


def test_chat(spark):
    talk = lambda k, *said: [(k, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said)]
    rows = talk(1, "a") + talk(2, "a", "b") + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "a", "b", "c") + talk(6, None) + talk(7, "") + [(8, 0, None, "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.rendered(df.withColumn("a", F.lit(1))).collect()}
    assert {k: v[:2] for k, v in got.items()} == {3: (3, 2), 4: (2, 1), 6: (1, 2), 8: (1, 1)}
    assert got[4][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.rendered(df.limit(0)).count() == 0
    # Rows without conv_id are conversations of one turn each; repeated rows are repeated turns; null turns come first.
    rows = [(None, 0, "user", "a"), (None, 0, "user", "z"), (None, 1, "user", "z"), (9, None, "user", "n"), (9, 0, "user", "m"), (9, 0, "user", "m")] + talk(1, "a", "b") + talk(2, "q") + [(None, 5, "user", "q")]
    got = sorted((r.conv_id or 0, r.n_turns, r.n_copies, r.chat.count("user")) for r in chat.rendered(spark.createDataFrame(rows, df.schema)).collect())
    assert got == [(0, 1, 2, 1), (1, 2, 1, 1), (2, 1, 2, 1), (9, 3, 1, 3)]


@pytest.mark.parametrize("with_labels", [False, True])
def test_fit_is_expectation_maximisation(with_labels):
    """The posterior against a plain computation over single documents, and what it is for: it tells the kinds apart."""
    r = random.Random(3)
    names = list(quality.RULES)
    shape, word = [j for j, x in enumerate(names) if x not in quality.LEXICAL], [j for j, x in enumerate(names) if x in quality.LEXICAL]
    kinds = ["good"] * 300 + ["junk"] * 60 + ["toxic"] * (40 if with_labels else 0)
    vote = lambda p: "0" if r.random() < 0.2 else "-" if r.random() < p else "+"
    docs = ["".join(vote(0.5 if k == "junk" else 0.02) if j in shape else (vote(0.9 if k == "toxic" else 0.01) if with_labels else "0") for j in range(len(names))) for k in kinds]
    lexical = quality.accuracies({(int(k == "toxic"), d): n for (k, d), n in Counter(zip(kinds, docs)).items()}) if with_labels else {}
    for j in lexical:
        for t, p in zip((True, False), lexical[j]):
            mine = [d[j] for k, d in zip(kinds, docs) if (k == "toxic") == t]
            assert p == pytest.approx((mine.count("-") + 0.5) / (mine.count("-") + mine.count("+") + 1)) or not t
    prior = {"good": 0.8, "junk": 0.15, "toxic": 0.05} if with_labels else {"good": 0.85, "junk": 0.15}
    bad, total = {c: [quality.BAD_VOTES[c]] * len(names) for c in (True, False)}, len(docs)

    def posterior(d):
        like = {}
        for k in prior:
            p = [bad[k != "junk"][j] if j in shape else lexical[j][k != "toxic"] if j in lexical else 0.5 for j in range(len(names))]
            like[k] = prior[k] * math.prod(p[j] if v == "-" else 1 - p[j] for j, v in enumerate(d) if v != "0" and (j in shape or j in lexical))
        return {k: x / sum(like.values()) for k, x in like.items()}

    post = [posterior(d) for d in docs]
    for _ in range(200):
        mass = {k: sum(x[k] for x in post) / total for k in prior}
        good = min(0.99, max(0.5, mass["good"]))
        prior = {k: good if k == "good" else (1 - good) * mass[k] / (1 - mass["good"]) for k in prior}
        for c in bad:
            for j in shape:
                weight = [1 - x["junk"] if c else x["junk"] for x in post]
                voted = sum(w for w, d in zip(weight, docs) if d[j] != "0")
                against = sum(w for w, d in zip(weight, docs) if d[j] == "-")
                bad[c][j] = (against + quality.BAD_VOTES[c] * (0.01 * total + 1)) / (voted + 0.01 * total + 1)
        post = [posterior(d) for d in docs]
    got = quality.fit(Counter(docs), lexical)
    assert [got[d] for d in docs] == pytest.approx([x["good"] for x in post], abs=1e-6)
    for k, right in (("good", lambda x: x >= 0.5), ("junk", lambda x: x < 0.5), ("toxic", lambda x: x < 0.5)):
        mine = [got[d] for d, kind in zip(docs, kinds) if kind == k]
        assert sum(map(right, mine)) >= 0.8 * len(mine)
    assert quality.fit({}) == {} and quality.accuracies({(0, "+" * len(names)): 3}) == {}


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    from rankloom.llm import common

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)
    one = common.written(spark.range(3), "one")
    two = common.written(one.withColumn("x", F.lit(1)), "two", instead_of=one)
    assert two.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        one.count()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    odd, even = [int(d) for d in digits[::-1][::2]], [int(d) for d in digits[::-1][1::2]]
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def brute_spans(text):
    found = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                found.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


TRICKY = ["a@b.c", "x a.b@c-d.e_f@g.hi.", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.003.0004", "4111 1111 1111 1111 4111-1111-1111-1111x 4111  1111", "+1 (234) 567-8901. +12 3 +1234567890123456", "a@b@c.d..e@f.g", "", None, "é 4111111111111111 ü+49 (0) 30 1234567 " + "1 " * 3000, "a.a.a." * 2000 + "@x.y", "1." * 5000, "a@b.c", "9" * 5000]


def test_base_spans(spark):
    r = random.Random(2)
    texts = TRICKY + ["".join(r.choice("0123456789.@+-() ab\n") for _ in range(200)) for _ in range(150)]
    got = {x.doc_id: x.base for x in pii.detect(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_spans(t) for t in texts]


def test_patterns_find_what_the_base_misses(spark):
    seeds = [f"words here, please call me: +1 (234) 567-{1000 + i} soon" for i in range(9)]
    texts = [*seeds, "words here, please call me: 234-567-9999 soon", "the year was 1234567 then", None]
    got = {x.doc_id: x for x in pii.detect(documents(spark, texts)).collect()}
    assert got[9].base == "" and got[9].spans.startswith("phone:28:") and got[10].spans == "" and got[11].spans == ""
    clean = pii.redacted(documents(spark, texts))
    rows = {x.doc_id: x for x in clean.collect()}
    assert rows[0].text == "words here, please call me: [PHONE] soon" and rows[0].n_chars == len(rows[0].text) and "[PHONE]" in rows[9].text
    assert rows[10].text == texts[10] and rows[11].text is None and clean.columns == documents(spark, texts).columns
    assert pii.detect(documents(spark, texts).limit(0)).count() == 0


def test_unseen_identifiers_may_outnumber_seeds_and_support_new_patterns(spark):
    seeds = [f"he said reach me at: +1 (234) 567-{1000 + i} soon" for i in range(10)]
    unseen = [f"he said reach me at: 234-567-{2000 + i} soon" for i in range(40)]
    second = [f"or try Direct line 234-567-{2000 + i} now" for i in range(12)]  # no seed ever follows this cue
    third = ["or try direct line 987-654-3210 now", "or try direct line 1234 now"]  # and one that stands after it only
    years = [f"he said reach me at: {1900 + i} soon" for i in range(2)]
    other = [f"in all there were {300 + i} of them" for i in range(30)] + [f"in all there were +1 (234) 567-{3000 + i} of them" for i in range(5)]
    texts = [*seeds, *unseen, *second, *third, *years, *other]
    got = {x.doc_id: x.spans for x in pii.detect(documents(spark, texts)).collect()}
    kinds = [got[i].partition(":")[0] for i in range(len(texts))]
    assert kinds == ["phone"] * 10 + ["phone"] * 40 + ["phone"] * 12 + ["phone", ""] + [""] * 2 + [""] * 30 + ["phone"] * 5


def test_personal_data_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(pii, "PART", 50)
    monkeypatch.setattr(pii, "MATCHES", 3)
    r = random.Random(4)
    piece = lambda: r.choice(["a@b.cd", "1.2.3.4", "+12 345 678 901", "é", "\U0001f600", "4111 1111 1111 1111", " 12345 ", "x", "word " * r.randint(1, 9), "\n", " me: 234-567-8901 ", f" me: +1 234 567 {r.randint(1000, 9999)} "])
    texts = ["".join(piece() for _ in range(r.randint(1, 150))) for _ in range(40)]
    found = {x.doc_id: x for x in pii.detect(documents(spark, texts)).collect()}
    clean = {x.doc_id: x.text for x in pii.redacted(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert found[i].base == brute_spans(t)
        at, out = 0, []
        for kind, s, e in [x.split(":") for x in found[i].spans.split(",") if x]:
            if int(s) >= at:
                out += [t[at : int(s)], f"[{kind.upper()}]"]
            at = max(at, int(e))
        assert clean[i] == "".join([*out, t[at:]])
    assert any("me: [PHONE]" in t for t in clean.values())


def test_left_context_is_of_whole_words(spark):
    t = "w" * 30 + " " + "v" * 250 + " call: "
    df = spark.createDataFrame([(t, len(t)), ("one two ", 8), ("two ", 4), ("", 0)], "t string, s int").select(pii.patterns(pii.parted(F.col("t")), F.col("s")).alias("w"))
    assert [r.w for r in df.collect()] == [["call:"], ["one two"], [], []]


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        assert 0.5 * docs.count() < after.count() <= docs.count(), name
        docs = after
    assert not docs.filter("text like '%@mail%'").count()
    mix = pipeline.STAGES[-1][1](spark, docs, folder)
    assert mix.count() == docs.count()
    assert {tuple(r) for r in pipeline.run(spark, folder).collect()} == {tuple(r) for r in mix.collect()}
    empty = docs.limit(0)
    assert all(stage(spark, empty, folder).count() == 0 for _, stage in pipeline.STAGES)


def test_names_never_delete_what_only_sounds_like_furniture():
    """Ids made of a heading's words, and classes that only begin like known names, name nothing."""
    text = lambda body: html_text.main_text(f"<body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>The first paragraph of this article, long enough to count.</p>{body}</article></body>")
    first = "Head\nThe first paragraph of this article, long enough to count."
    for tag, names in (("h2", 'id="comments-on-the-draft"'), ("h2", 'id="subscription-pricing"'), ("h2", 'id="comments"'), ("p", 'class="ad-hoc"'), ("p", 'id="cookies"'), ("blockquote", 'class="navigation-systems"'), ("div", 'class="breadcrumbs-of-history"')):
        assert text(f"<{tag} {names}>Some words that stay here.</{tag}>") == f"{first}\nSome words that stay here.", (tag, names)
    assert text('<section id="navigation-systems"><p>One paragraph.</p><p>Another one.</p></section>') == f"{first}\nOne paragraph.\nAnother one."
    assert text('<table class="cookie-recipes"><tr><td>Flour</td><td>Butter</td></tr></table>') == f"{first}\nFlour\nButter"
    for tag, names in (("div", 'class="ad"'), ("div", 'class="cookie-banner"'), ("section", 'id="comments"'), ("ul", 'class="site-nav-list"'), ("div", 'role="navigation"'), ("p", 'class="advert"'), ("div", 'class="newsletter_box"'), ("div", 'class="ad-slot-3"')):
        assert text(f"<{tag} {names}>Words that go.</{tag}>") == first, (tag, names)
    # What has half of an article's text is no furniture, whatever its name.
    assert html_text.main_text(f"<article><div class=comments>{'<p>A long text of many words.</p>' * 9}</div><p>End.</p></article>").count("many words") == 9


def test_every_dense_article_stays():
    p = lambda k, n: f"<article><h2>Part {k}</h2>" + "".join(f"<p>Paragraph {i} of part {k} with enough words in it to be dense, and more.</p>" for i in range(n)) + "</article>"
    want = lambda k, n: [f"Part {k}", *(f"Paragraph {i} of part {k} with enough words in it to be dense, and more." for i in range(n))]
    nav = "<nav><a href=/>Home</a><a href=/b>More</a></nav>"
    teaser = "<article><h3><a href=/t>Another story of ours</a></h3><p><a href=/t>Read on.</a></p></article>"
    for wrap in ("<body>{0}{1}</body>", "<body>{0}<main>{1}</main></body>", "<body><div>{0}<div>{1}</div></div></body>"):
        for a, b in ((3, 3), (6, 2), (2, 6), (1, 1)):
            for more in ("", teaser) if a + b > 2 else ("",):
                    assert html_text.main_text(wrap.format(nav, p(1, a) + p(2, b) + more)).split("\n") == want(1, a) + want(2, b), (wrap, a, b, more)


def test_without_article_the_threshold_decides():
    """Blocks of text beside each other, links around them: the result is the subtrees that an independent reading of the formula takes."""
    blocks = [("intro", 2), ("body", 7), ("tail", 3)]
    page = "<body><div><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div>" + "".join(f"<div id={name}>" + "".join(f"<p>Sentence {i} of the {name}, of a length that makes it dense enough.</p>" for i in range(n)) + "</div>" for name, n in blocks) + "<div><a href=/x>Imprint</a> <a href=/y>Terms</a></div></body>"
    assert html_text.main_text(page).split("\n") == [f"Sentence {i} of the {name}, of a length that makes it dense enough." for name, n in blocks for i in range(n)]


def test_bootstrapping_goes_on_until_nothing_moves(spark):
    """A chain of patterns, each known only by what the one before it found: fourteen steps from the seeds."""
    hops, n = 14, 150
    rows = [("phone", f"+1 555 {i:07d}", ["w0"]) for i in range(n)]
    rows += [(None, f"{h:03d}-{i:07d}", [f"w{h - 1}", f"w{h}"]) for h in range(1, hops + 1) for i in range(n)]
    said = spark.createDataFrame(rows, "kind string, v string, w array<string>")
    found = {r.w: r.confidence for r in pii.trusted(said).collect() if r.kind == "phone"}
    assert set(found) == {f"w{h}" for h in range(hops + 1)} and min(found.values()) >= pii.CONFIDENCE
    assert len([r for r in pii.trusted(said, rounds=3).collect() if r.kind == "phone"]) < hops


def test_repeated_benchmark_rows_are_one_item(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = documents(spark, [f"before {item} after", "nothing here"])
    bench = spark.createDataFrame([(1, item)] * 500 + [(2, None), (2, None), (None, item)], "item_id int, text string")
    got = {r.doc_id: (r.n_hit, r.items, len(r.matches)) for r in decontaminate.find(docs, bench, keep=["doc_id"]).collect()}
    assert got == {0: (11, [1], 2), 1: (0, [], 0)}
