"""The queries opN_ themselves, on the smallest tables, against brute force or SQL."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest

from rankloom.llm import queries
from tests.llm.test_llm import brute_hits, brute_repeats, brute_spans, near_classes

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "held_out", "lang_pred", "score"}, "op2": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op3": {"page_id", "url", "text", "n_chars"},
    "op4": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op5": {"conv_id", "n_turns", "n_copies", "chat"}, "op6": {"doc_id", "size", "source_size", "target", "taken"},
    "op7": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op8": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op10": {"doc_id", "class_id"},
}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def of(n):
        if n not in made:
            name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
            made[n] = [r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()]
        return made[n]

    return of


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("n", range(1, 11))
def test_columns_and_rows(spark, result, n):
    rows = result(n)
    assert COLUMNS[f"op{n}"] <= set(rows[0])
    if n != 5:
        key = "page_id" if n == 3 else "doc_id"
        table = "pages" if n == 3 else "documents"
        want = Counter(r[key] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect())
        assert Counter(r[key] for r in rows) == want


def test_languages(result, docs):
    learned = {d.lang for d in docs.values() if d.lang and zlib.crc32(str(d.doc_id).encode()) % 4 != 2}
    for r in result(1):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["lang_pred"] in learned | {"und"} and 0 <= r["score"] <= 1
    right = [r["lang_pred"] == docs[r["doc_id"]].lang for r in result(1) if r["held_out"] and docs[r["doc_id"]].lang and len(docs[r["doc_id"]].text or "") > 100]
    assert sum(right) >= 0.95 * len(right)


def test_repeats(result, docs):
    ids = sorted(docs)
    want = dict(zip(ids, brute_repeats([(docs[i].text or "").encode() for i in ids], 400)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result(2)} == want


def test_pages_are_articles(result):
    for r in result(3):
        assert r["n_chars"] == len(r["text"]) and r["text"] == "\n".join(b for b in (" ".join(x.split()) for x in r["text"].split("\n")) if b)
    assert all(r["text"] for r in result(3))


def test_base_scores(result, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*(d.text or "").encode().lower().split(), None] for i, d in docs.items()}
    count = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    for r in result(4):
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0


@pytest.mark.parametrize("n", [5, 6])
def test_sql(result, n):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = con.execute(next(s for q, s in queries.SQL.items() if q.startswith(f"op{n}_")))
    names = [c[0] for c in got.description]
    assert set(names) == set(result(n)[0])
    assert sorted(repr([row[names.index(c)] for c in sorted(names)]) for row in got.fetchall()) == sorted(repr([r[c] for c in sorted(names)]) for r in result(n))


def test_mix_keeps_near_its_targets(result, docs):
    taken, target = Counter(), {}
    for r in result(6):
        source = docs[r["doc_id"]].source
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())


def test_benchmark_hits(spark, result, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    ids = sorted(docs)
    for i, (n, hit, found) in zip(ids, brute_hits([docs[i].text for i in ids], items)):
        r = next(r for r in result(7) if r["doc_id"] == i)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), sha(",".join(sorted(map(str, found)))), hit > 0)
    assert any(r["contaminated"] for r in result(7))


def test_quality_counts(result, docs):
    for r in result(8):
        words = (docs[r["doc_id"]].text or "").encode().split()
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(words), len(again))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r["base_failed"] and r["kept"])
    assert 0.5 < sum(r["kept"] for r in result(8)) / len(result(8)) < 1


def test_personal_data(result, docs):
    for r in result(9):
        base = brute_spans(docs[r["doc_id"]].text)
        assert r["base_sha256"] == sha(base) and set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert all(r[f"n_{k}"] == sum(s.startswith(k) for s in base.split(",")) for k in ("email", "ip", "card", "phone"))


def test_near_duplicates(result, docs):
    ids = sorted(docs)
    want = near_classes([docs[i].text for i in ids])
    got = [next(r["class_id"] for r in result(10) if r["doc_id"] == i) for i in ids]
    assert got == [ids[k] for k in want]
