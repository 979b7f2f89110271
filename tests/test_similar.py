"""Similarity joins, decisions in order and the stored text index, against brute force."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import FORM_A, FORM_B, name_similarity, token_set_ratio, tokens_a, tokens_b
from rankloom.operators import graph, index, similar, tables, text_store

WORDS = "red green blue gold pink grey teal lime brass steel copper nickel tin promo small large medium polished brushed anodized plated burnished".split()


def near_by_hand(texts, threshold):
    return {(i, j): token_set_ratio(texts[i], texts[j]) for i in range(len(texts)) for j in range(i + 1, len(texts)) if token_set_ratio(texts[i], texts[j]) >= threshold}


@pytest.mark.parametrize("threshold", [99.0, 90.0])
def test_near_pairs_are_all_pairs(spark, threshold):
    r = random.Random(int(threshold))
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n)) for n in (3, 12, 60, 61, 150)]
    texts = [*base, "", "  ", "red", "red red", "red green", "green red"]
    for _ in range(90):
        t = r.choice(base)
        i = r.randrange(len(t))
        texts.append(r.choice([t[:i] + t[i + 1 :], t[:i] + "q" + t[i:], t + " more", " ".join(t.split()[1:]), " ".join(sorted(t.split())), t.replace("red", "read"), t + " " + r.choice(base), t[: len(t) // 2]]))
    texts = list(dict.fromkeys(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    got = {(x.x, x.y): x.score for x in similar.near_pairs(rows, "id", "t", threshold).collect()}
    want = near_by_hand(texts, threshold)
    assert set(got) == set(want) and len(want) > 50
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_near_pairs_of_long_edited_tokens(spark):
    r = random.Random(4)
    long = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (123, 200, 260, 400)]
    texts = long + [t[:2] + "z" + t[3:] for t in long] + [t[:-1] + "yx" for t in long] + [" ".join(long[:3]), f"x{long[0]}q {long[1]}q x{long[2]}", long[3][::-1], "a" * 150, "a" * 151]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert {(x.x, x.y) for x in similar.near_pairs(rows, "id", "t").collect()} == set(near_by_hand(texts, 99)) != set()


def test_near_pairs_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "alone")], "id int, t string")
    assert similar.near_pairs(rows, "id", "t").collect() == [] == similar.near_pairs(rows.limit(0), "id", "t").collect()


def test_near_pairs_by_blocks_and_of_repeated_rows(spark, monkeypatch):
    r = random.Random(8)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n)) for n in (30, 31, 60, 61, 61)]
    texts = list(dict.fromkeys(base + [t[:i] + "q" + t[i + 1 :] for t in base for i in r.sample(range(len(t)), 12)]))
    monkeypatch.setattr(similar, "BLOCK", 4)
    rows = spark.createDataFrame(list(enumerate(texts)) * 3, "id int, t string").repartition(3)
    got = sorted((x.x, x.y) for x in similar.near_pairs(rows, "id", "t").collect())
    assert got == sorted(near_by_hand(texts, 99)) and len(got) > 100


def test_texts_that_share_their_rarest_tokens_are_no_candidates(spark):
    r = random.Random(9)
    texts = [" ".join(["rarest", "token", *("".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(40))]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    told = similar.heads(rows, similar.counters(rows), 99.0)
    assert told.count() == 300 and similar.edited_pairs(told, 0.99).count() == 0
    assert told.filter("size(rare) > 0").count() == 0


def test_meetings_of_one_token_are_not_written(spark, monkeypatch):
    """Of the texts that have a short text's rarest token, only those with all its tokens are compared with it, block by block or not."""
    texts = ["rare often much", *(f"rare {'often' if i % 2 else 'seldom'} {'much' if i % 3 else 'little'} w{i} v{i}" for i in range(60)), *(f"often much seldom little u{i}" for i in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = near_by_hand(texts, 99)
    for entries, meetings in ((1 << 22, 1 << 21), (16, 8)):
        monkeypatch.setattr(similar, "ENTRIES", entries)
        monkeypatch.setattr(similar, "MEETINGS", meetings)
        told = similar.heads(rows, similar.counters(rows), 99.0)
        met = {(r.x, r.y) for r in similar.held_pairs(told, rows, 1 / 99).collect()}
        assert {p for p in met if p[0] == 0} == want.keys() and len(want) == 20
        assert {(r.x, r.y) for r in similar.near_pairs(rows, "k", "t").collect()} == want.keys()


def test_similar_names_are_all_pairs(spark):
    r = random.Random(2)
    known = {" ".join(r.sample(WORDS, r.randint(1, 3))) for _ in range(60)} | {"a", "ab", "abc", "new new york"}
    names = set(known)
    for k in list(known) * 3:
        i = r.randrange(len(k))
        names.add(r.choice([k[:i] + k[i + 1 :], k[:i] + "x" + k[i:], " ".join(reversed(k.split())), k + " shop", k.split()[0], k + " " + k, k[:i] + "zq" + k[i + 1 :]]))
    names = {n for n in names if n}
    got = {(x.name, x.other): x.score for x in similar.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in known], "other string"), 88.0).collect()}
    want = {(n, k): name_similarity(n, k) for n in names for k in known if name_similarity(n, k) >= 88}
    assert got == want and len(want) > len(known)
    with pytest.raises(ValueError):
        similar.similar_names(None, None, 80.0)


def test_normal_names_take_the_most_similar_alias(spark):
    raw = spark.createDataFrame([(x,) for x in ("Promo_Brushed Steel", "promo brushd steel", "steel", "Granite", "", None)], "s string")
    names = spark.createDataFrame([("promo brushed steel", "steel, brushed"), ("brushed steel promo", "other"), ("tin", "tin")], "alias string, skill string")
    got = {r.s: r.skill for r in graph.normalised(raw, "s", names).collect()}
    known = sorted(names.collect(), key=lambda r: r.alias)
    for value, skill in got.items():
        text = " ".join((value or "").lower().replace("_", " ").split())
        best = max(known, key=lambda r: name_similarity(text, r.alias))
        assert skill == (None if value is None else best.skill if text and name_similarity(text, best.alias) >= 88 else text)


def fold(ordered, names, threshold=88.0):
    """The sequential form: one value after the other."""
    skill_of = dict(names)
    for raw in ordered:
        text = " ".join(raw.lower().replace("_", " ").replace("-", " ").split())
        if not text or text in skill_of:
            continue
        best = max(sorted(skill_of), key=lambda a: name_similarity(text, a), default=None)
        skill_of[text] = skill_of[best] if best is not None and name_similarity(text, best) >= threshold else text
    return skill_of


@pytest.mark.parametrize("seed", range(2))
def test_vocabulary_grows_as_the_sequential_fold(spark, seed):
    r = random.Random(seed)
    ordered = []
    for _ in range(80):
        k = " ".join(r.sample(WORDS, r.randint(1, 3)))
        i = r.randrange(len(k))
        ordered += [k, r.choice([k[:i] + "x" + k[i:], k.upper(), k.replace(" ", "_"), k[:i] + k[i + 1 :], k + " " + r.choice(WORDS)])]
    r.shuffle(ordered)
    names = {"red": "red", "rouge": "red", "polished tin": "tin"}
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*ordered, ""])], "at int, raw string").repartition(4)
    got = graph.grown(rows, "raw", "at", spark.createDataFrame(list(names.items()), "alias string, skill string"))
    assert {x.alias: x.skill for x in got.collect()} == fold(ordered, names)


def dedup_by_hand(rows, threshold=99):
    stays, gone = [], {}
    for at, (key, text) in enumerate(rows):
        if any(k == key for k, _, _ in stays):
            gone[at] = "duplicate_id"
        elif any((text or "").strip() and (t or "").strip() and token_set_ratio(text, t) >= threshold for _, t, _ in stays):
            gone[at] = "near_duplicate_text"
        else:
            stays.append((key, text, at))
    return {at for _, _, at in stays}, gone


def test_a_key_is_taken_only_by_a_row_that_stays(spark):
    rows = [("a", "one two three four"), ("b", "four three two one"), ("b", "another text"), ("b", "third text"), ("c", None), ("c", ""), ("d", "another text")]
    assert dedup_by_hand(rows) == ({0, 2, 4}, {1: "near_duplicate_text", 3: "duplicate_id", 5: "duplicate_id", 6: "near_duplicate_text"})
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "id string, t string, at int")
    stay, gone = tables.deduplicated(df, "id", "t", "at")
    assert {r.at for r in stay.collect()} == {0, 2, 4}
    assert {(r.at, r.reason, r.near_of) for r in gone.collect()} == {(1, "near_duplicate_text", "a"), (3, "duplicate_id", None), (5, "duplicate_id", None), (6, "near_duplicate_text", "b")}


@pytest.mark.parametrize("seed", range(2))
def test_deduplication_is_the_sequential_pass(spark, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(60)) for _ in range(8)] + ["", " "]
    rows = []
    for _ in range(120):
        t = r.choice(base)
        rows.append((f"k{r.randint(0, 40)}", r.choice([t, t, t[:5] + "x" + t[6:], t + " more", " ".join(t.split()[:-1]), t + " " + r.choice(base)])))
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "id string, t string, at int").repartition(3)
    stay, gone = tables.deduplicated(df, "id", "t", "at")
    want, reasons = dedup_by_hand(rows)
    assert {x.at for x in stay.collect()} == want
    assert {x.at: x.reason for x in gone.collect()} == reasons


# --- text index ---------------------------------------------------------------------------------------------------------


def test_terms_in_batches_are_those_of_the_jvm(spark):
    texts = ["Plain C++ and C#, node.js! x_y", "É K İstanbul ﬁ ΣΑΣ", "", None, "tab\tnew\nline nbsp 12.5%", "ſharp ß"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for form, column in ((FORM_A, tokens_a), (FORM_B, tokens_b)):
        for t, found in df.select("t", column("t")).collect():
            assert [w.decode() for w in form.terms(t)] == list(found or [])


def corpus(spark, n=3000, seed=1):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.7)) % 5000}" for _ in range(4000)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows[5] = (5, None)
    rows[7] = rows[8] = (7, "w1 w2 w3"), (8, "w1 w2 w3")
    rows = [x if isinstance(x[0], int) else y for x, y in zip(rows, [None] * 7 + [(7, "w1 w2 w3"), (8, "w1 w2 w3")] + [None] * (n - 9))]
    asked = [(q, " ".join(r.choice(vocab) for _ in range(r.randint(1, 8)))) for q in range(25)] + [(90, "absent words"), (91, ""), (92, "w1 w1 w2")]
    return spark.createDataFrame(rows, "id long, t string").repartition(6), spark.createDataFrame(asked, "q int, text string")


@pytest.mark.parametrize("form", ["a", "b"])
def test_stored_index_answers_as_a_pass_over_the_corpus(spark, tmp_path, form, monkeypatch):
    monkeypatch.setattr(text_store, "BLOCK", 8)
    monkeypatch.setattr(text_store, "BUCKET_TERMS", 100)
    docs, asked = corpus(spark)
    path = f"file://{tmp_path}/index"
    text_store.write(docs, "id", "t", path, form)
    store = text_store.Store(spark, path)
    whole = (index.bm25_a if form == "a" else index.bm25_b)(docs, asked, "id", "t", "q", "text").withColumn("score", F.round("score", 6))
    want = {(r.q, r.id, r.rank, r.score) for r in index.top_k(whole, 5, "q", [F.desc("score"), F.asc("id")]).collect()}
    for head, driver in ((4, 1 << 20), (40, 1 << 20), (1 << 30, 1 << 20), (4, 0), (40, 0)):
        monkeypatch.setattr(text_store, "DRIVER", driver)
        got = {(r.q, r.doc_id, r.rank, r.score) for r in store.search(asked, "q", "text", 5, head=head).collect()}
        assert {x[:3] for x in got} == {x[:3] for x in want} and len(want) > 60
        assert sorted(x[3] for x in got) == pytest.approx(sorted(x[3] for x in want), abs=2e-6)
    few = {r.q: r.text for r in asked.collect()}
    assert {(r.q, r.doc_id, r.rank) for r in store.request(few, 5, "q").collect()} == {x[:3] for x in want}


def test_a_request_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_store, "BUCKET_TERMS", 20)
    docs, asked = corpus(spark, 1500)
    path = f"file://{tmp_path}/index"
    text_store.write(docs, "id", "t", path)
    store = text_store.Store(spark, path)
    terms = [b"w1", b"w2", b"absent"]
    known = store.terms(terms)
    assert set(known) == {b"w1", b"w2"} and all(sum(n for _, n in levels) == df for df, levels in known.values())
    read = store.blocks({t: 0 for t in known})
    wanted = {f"bucket={b}" for b in store.buckets([b"w1", b"w2"])}
    files = {f.split("/blocks/")[1].split("/")[0] for f in read.inputFiles()}
    assert files == wanted and len(wanted) <= 2 < len(glob.glob(f"{tmp_path}/index/blocks/bucket=*")) / 4
    assert sum(len(r.docs) for r in read.collect()) == sum(df for df, _ in known.values())
    # Blocks from a level up are the heaviest of their term.
    levels = known[b"w1"][1]
    top = store.blocks({b"w1": levels[0][0]}).collect()
    assert 0 < sum(len(r.docs) for r in top) < known[b"w1"][0] and all(r.level == levels[0][0] and r.weights[0] == r.top == max(r.weights) for r in top)


def test_stored_index_of_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "id long, t string")
    text_store.write(docs, "id", "t", f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "some words")], "q int, text string")
    assert text_store.Store(spark, f"file://{tmp_path}/index").search(asked, "q", "text", 3).collect() == []


def test_joined_scores_are_those_of_the_small_matrix(spark, monkeypatch):
    docs, asked = corpus(spark, 400)
    found = {}
    for wanted in (200_000, 3):
        monkeypatch.setattr(index, "WANTED", wanted)
        for name, bm25 in (("a", index.bm25_a), ("b", index.bm25_b)):
            found[wanted, name] = {(r.q, r.id): r.score for r in bm25(docs, asked, "id", "t", "q", "text").collect()}
    for name in "ab":
        one, two = found[200_000, name], found[3, name]
        assert set(one) == set(two) and all(one[k] == pytest.approx(two[k]) for k in one)


@pytest.mark.parametrize("cutoff", [2, 3])
def test_distances_are_those_of_a_breadth_first_search(spark, cutoff, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 4)
    r = random.Random(cutoff)
    edges = {(f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}") for _ in range(70)} | {("hub", f"n{i}") for i in range(0, 60, 3)} | {("x", "x")}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    sources, targets = [f"n{i}" for i in range(0, 60, 4)] + ["hub", "away"], [f"n{i}" for i in range(0, 60, 5)] + ["away", "x"]
    want = {}
    for s in sources:
        at, seen = {s}, {s: 0}
        for d in range(1, cutoff + 1):
            at = {b for a in at for b in near.get(a, ()) if b not in seen}
            seen |= dict.fromkeys(at, d)
        want |= {(s, t): seen[t] for t in targets if t in seen}
    nodes = lambda x: spark.createDataFrame([(n,) for n in x], "node string")
    got = graph.distances(spark.createDataFrame(list(edges), "src string, dst string"), nodes(sources), nodes(targets), cutoff)
    assert {(x.src, x.dst): x.distance for x in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("form", ["a", "b"])
def test_many_queries_are_one_pass_over_the_store(spark, tmp_path, monkeypatch, form):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(120)], "id int, t string")
    asked = spark.createDataFrame([(q, " ".join(rng.choice("abcdefghz") for _ in range(3))) for q in range(40)], "q int, qt string")
    text_store.write(docs, "id", "t", f"{tmp_path}/i", form)
    monkeypatch.setattr(text_store, "DRIVER", 0)
    monkeypatch.setattr(text_store.Store, "many", lambda *_: pytest.fail("blocks are read round by round"))
    found = text_store.Store(spark, f"{tmp_path}/i").search(asked, "q", "qt", 4)
    bm25 = index.bm25_a if form == "a" else index.bm25_b
    want = index.top_k(bm25(docs, asked, "id", "t", "q", "qt").withColumn("score", F.round("score", 6)), 4, "q", [F.desc("score"), F.asc("id")])
    assert sorted(tuple(r) for r in found.collect()) == sorted((r.q, r.id, r.rank, r.score) for r in want.collect())
