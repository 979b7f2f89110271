import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import flags
from rankloom.operators import behaviour, embed, evaluate, explain, filters, graph, index, parse, records, rules, score, tables


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_rrf(spark):
    lists = lambda rows: spark.createDataFrame(rows, "q int, d string, rank int, score double")
    got = {r.d: r.fused for r in index.rrf(lists([(1, "x", 1, 9.0), (1, "y", 2, 8.0)]), lists([(1, "y", 1, 5.0), (1, "x", 2, 4.0), (1, "z", 3, 1.0)]), "q", "d").collect()}
    assert got["x"] == pytest.approx(1 / 61 + 1 / 62) and got["y"] == pytest.approx(got["x"]) and got["z"] == pytest.approx(1 / 63)


def test_min_max(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "s double")
    assert sorted(r.scaled for r in index.min_max(df, "s").collect()) == [0, 0.5, 1]
    assert {r.scaled for r in index.min_max(df.withColumn("s", F.lit(4.0)), "s").collect()} == {0}


def test_upsert_keeps_the_first_place_and_the_last_value(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("a", 3, 30)], "k string, n int, v int")
    assert {(r.k, r.v, r.pos) for r in index.upsert(rows, "k", "n", ["v"]).collect()} == {("a", 30, 1), ("b", 20, 2)}


def test_hash_embedding(spark):
    docs = spark.createDataFrame([("a", "Python retrieval engineer"), ("b", "Python retrieval engineer"), ("c", "")], "id string, t string")
    got = {r.id: r.vector for r in embed.dense(docs, "id", embed.prepared(F.col("t"), "Represent:"), 64).collect()}
    assert len(got["a"]) == 64 and got["a"] == got["b"]
    assert math.isclose(sum(x * x for x in got["a"]), 1, rel_tol=1e-5)
    none = embed.dense(docs.filter("id = 'c'"), "id", F.col("t"), 8).first().vector
    assert none == [0.0] * 8


def test_hard_filters(spark):
    rows = [("c1", "Bengaluru, India", "6", ["python", "fastapi"], True), ("c2", "Paris", "6", ["python", "fastapi"], False), ("c3", "Bengaluru", "2", ["python", "fastapi"], False), ("c4", "Bengaluru", "6", ["python"], False), ("c5", None, None, ["Python", "FastAPI"], True), ("c6", "Remote", "7", [], True)]
    df = spark.createDataFrame(rows, "id string, location string, years string, skills array<string>, want boolean")
    ok = filters.location_passes(F.col("location"), F.lit("Bengaluru")) & filters.seniority_passes(F.col("years"), F.lit("Senior")) & filters.must_have_passes(F.col("skills"), F.array(F.lit("Python"), F.lit("FastAPI")))
    assert [(r.id, r.got) for r in df.select("id", ok.alias("got")).orderBy("id").collect()] == [(i, w) for i, *_, w in rows]


def test_relocation_hub_and_unreadable_years(spark):
    r = one(spark, a=filters.location_passes(F.lit("Chennai"), F.lit("Pune/Noida, Somewhere")), b=filters.location_passes(F.lit("Chennai"), F.lit("Oslo")), c=filters.seniority_passes(F.lit("many"), F.lit("mid")), d=filters.seniority_passes(F.lit("NaN"), F.lit("mid")))
    assert (r.a, r.b, r.c, r.d) == (True, False, False, True)


def test_behaviour(spark):
    day = lambda s: behaviour.day(F.lit(s))
    t = lambda *xs: F.array(*[F.struct(F.lit(d).alias("date"), F.lit(c).cast("double").alias("count"), F.lit(p).alias("repo")) for d, c, p in xs]).cast(behaviour.TIMELINE)
    snaps = F.array(F.struct(F.lit("2022-01-01").alias("date"), F.array(F.lit("a")).alias("skills")), F.struct(F.lit("2024-01-01").alias("date"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("skills")))
    r = one(spark, same=behaviour.recency(day("2026-06-17")), half=behaviour.recency(day("2026-03-19")), none=behaviour.recency(day(None)), bad=behaviour.recency(day("x")), counts=behaviour.frequency(t(("", 10, "a"), ("", 15, "b"))), plain=behaviour.frequency(t(("", None, "a"), ("", None, "b"))), velocity=behaviour.velocity(snaps), breadth=behaviour.breadth(F.lit("https://x"), t(("", 1, "a"), ("", 1, "b"), ("", 1, "a"))), nothing=behaviour.breadth(F.lit(None), t()),
            trust=behaviour.trust(F.lit(True), F.lit(True), F.lit(True), F.lit(10), F.lit(1)), avail=behaviour.availability(F.lit(1.0), F.lit(True), F.lit(15)), engage=behaviour.engagement(F.lit(0.9), F.lit(2.0), F.lit(0.8)))
    assert (r.same, r.none, r.bad, r.counts, r.plain, r.breadth, r.nothing) == (1, 0.5, 0.5, 25, 2, pytest.approx(0.6), 0)
    assert r.half == pytest.approx(0.5) and r.velocity == pytest.approx(1, abs=0.01)
    assert (r.trust, r.avail) == (pytest.approx(1), pytest.approx(1)) and r.engage == pytest.approx(0.4 * 0.9 + 0.3 / (1 + 2 / 24) + 0.3 * 0.8)


def test_population_scaling(spark):
    df = spark.createDataFrame([(1, 2.0, 7.0), (2, 4.0, 7.0)], "id int, a double, b double")
    assert [(r.a, r.b) for r in behaviour.population_scaled(df, ("a", "b")).orderBy("id").collect()] == [(0, 0.5), (1, 0.5)]


def test_scores(spark):
    ones = {k: F.lit(1.0) for k in score.WEIGHTS}
    r = one(spark, all=score.weighted(ones), less=score.weighted(ones | {"skill_overlap": F.lit(None).cast("double")}), jac=score.jaccard(F.array(F.lit("python"), F.lit("fastapi")), F.array(F.lit("python"))), sen=score.seniority(F.lit(2.5), F.lit("senior")), full=score.seniority(F.lit(6.0), F.lit("senior")), p2=score.penalised(F.lit(1.0), F.lit(2), F.lit(2), F.lit(False)), p6=score.penalised(F.lit(1.0), F.lit(2), F.lit(6), F.lit(False)), flagged=score.penalised(F.lit(1.0), F.lit(0), F.lit(0), F.lit(True)), blend=score.blended(F.lit(0.8), F.lit(0.6), 0.5), parts=score.breakdown(ones))
    assert (r.all, r.less, r.jac, r.sen, r.full, r.p2, r.p6, r.flagged, r.blend) == tuple(pytest.approx(x) for x in (1, 1, 0.5, 0.5, 1, 0.25, 0.8, 0.01, 0.7))
    assert r.parts == pytest.approx(score.WEIGHTS)


def test_tags(spark):
    def tagged(**f):
        base = {k: F.lit(f.get(k, 0.5)) for k in ("seniority_match", "behavioral_score", "bm25_score", "dense_similarity", "trajectory_alignment", "skill_overlap")} | {"inconsistency": F.lit(0.0)}
        return one(spark, t=explain.tags(base)).t

    gem = tagged(behavioral_score=0.8, bm25_score=0.1, dense_similarity=0.1)
    assert "Hidden Gem" in gem and "Career Switcher" not in gem
    assert {"Hidden Gem", "Fast Learner", "Career Switcher"} & set(tagged(behavioral_score=0.65, trajectory_alignment=0.7)) == {"Fast Learner"}
    switch = tagged(trajectory_alignment=0.8, skill_overlap=0.05, behavioral_score=0.0)
    assert "Career Switcher" in switch and "High Engagement" not in switch


def test_accepted_answers(spark):
    good = '{"matched_points": ["Knows Python well", "Likes tea"], "confidence": 0.9, "narrative": "fine"}'
    said = lambda a: explain.accepted(F.lit(a), F.array(F.lit("python")), F.array(F.lit("template")), F.lit("plain"))
    r = one(spark, a=said("noise " + good), b=said("no json"))
    assert (r.a.matched_points, r.a.narrative, r.a.confidence) == (["Knows Python well"], "fine", 0.9)
    assert (r.b.matched_points, r.b.narrative) == (["template"], "plain")


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (1, "c3", 3)], "q int, d string, rank int")
    rel = spark.createDataFrame([(1, "c1", 0), (1, "c2", 3), (1, "c3", 1)], "q int, d string, rel int")
    only = spark.createDataFrame([(1, "c2", 1)], "q int, d string, rel int")
    rows = evaluate.judged(ranking, only, "q", "d")
    assert [evaluate.precision_at(rows, "q", k).first().value for k in (1, 2, 3)] == [0, 0.5, pytest.approx(1 / 3)]
    assert evaluate.reciprocal_rank(rows, "q").first().value == 0.5
    assert evaluate.ndcg_at(evaluate.judged(ranking, rel, "q", "d"), rel, "q", 2).first().value == pytest.approx(0.5787, abs=1e-4)


def test_result_faults(spark):
    good = [(f"CAND_{i:07d}", str(i), str(1 - i / 1000), "") for i in range(1, 101)]
    faults = lambda rows: {r.fault for r in evaluate.result_faults(spark.createDataFrame(rows, "candidate_id string, rank string, score string, reasoning string")).collect()}
    assert faults(good) == set()
    assert "number of rows" in faults(good[:-1])
    assert faults([good[0], *good[:1], *good[2:]]) >= {"repeated candidate_id", "repeated rank", "missing rank"}
    assert "rank" in faults([("CAND_0000001", "01", "0.999", ""), *good[1:]])
    assert "score increases" in faults([*good[:49], ("CAND_0000050", "50", "0.99999", ""), *good[50:]])
    assert "tie order" in faults([(good[1][0], "1", "0.999", ""), (good[0][0], "2", "0.999", ""), *good[2:]])


def test_skill_names_and_distances(spark):
    names = graph.aliases(spark)
    raw = spark.createDataFrame([("Python3",), ("fast api",), ("Postgres",), ("pythn",), ("Rust",)], "s string")
    assert {r.s: r.skill for r in graph.normalised(raw, "s", names).collect()} == {"Python3": "python", "fast api": "fastapi", "Postgres": "sql", "pythn": "python", "Rust": "rust"}
    edges = graph.implied(spark, names)
    assert edges.count() == 6
    nodes = lambda *x: spark.createDataFrame([(v,) for v in x], "node string")
    got = {(r.src, r.dst): r.distance for r in graph.distances(edges, nodes("python", "fastapi", "rust"), nodes("python")).collect()}
    assert got == {("python", "python"): 0, ("fastapi", "python"): 1}
    line = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e")], "src string, dst string")
    far = lambda k: {r.dst: r.distance for r in graph.distances(line, nodes("a"), nodes("a", "b", "c", "d", "e"), k).collect()}
    assert far(2) == {"a": 0, "b": 1, "c": 2} and far(3) == {"a": 0, "b": 1, "c": 2, "d": 3}
    held = spark.createDataFrame([("candidate:1", "a"), ("candidate:1", "b")], "src string, dst string")
    assert graph.distances(held, nodes("a"), nodes("b")).first().distance == 2
    grown = graph.grown(spark.createDataFrame(list(enumerate(["pythn", "Rust", "rust lang", "Rust"])), "at int, raw string"), "raw", "at", names)
    assert {"pythn": "python", "rust": "rust", "rust lang": "rust", "py": "python"}.items() <= {r.alias: r.skill for r in grown.collect()}.items()


def test_sections(spark):
    texts = ["Python, SQL, FastAPI, Qdrant", "Built data platforms for recruiting teams.", "Hi\nSkills\nPython, FastAPI\nExperience:\n\nSenior Engineer at Acme\nBuilt", ""]
    got = {r.id: r.sections for r in parse.sections(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()}
    assert got[0] == {"skills": texts[0]} and got[1] == {"summary": texts[1]}
    assert got[2] == {"summary": "Hi", "skills": "Python, FastAPI", "experience": "Senior Engineer at Acme\nBuilt"} and got[3] == {"summary": ""}


def test_experience(spark):
    texts = {
        "two": "Senior Engineer at Acme, Jan 2020 - Mar 2022\n- Built ranking APIs.\nEngineer at Beta, 2018 - 2019\n- Shipped data pipelines.",
        "bullets": "- Backend Engineer at Acme 2020 - Present\n- Data Engineer at Beta 2018 - 2020",
        "dates": "Some words first\nAnalyst, Mar 2019 - Jan 2020\nmore &amp; more",
        "sentence": "Wrote many things. And more.",
        "none": None,
        "no title": "...\n. . .",
        "listed": ".\n* First thing\n* Second thing",
        "wrong order": "Cook at Inn, 2022 - 2020",
    }
    rows = spark.createDataFrame(list(texts.items()), "id string, t string")
    got = {r.id: [(x.title, x.company, x.duration_months) for x in r.experience_entries] for r in parse.experience(rows, "id", "t", "2026-06-17").collect()}
    assert got["two"] == [("Senior Engineer", "Acme", 26), ("Engineer", "Beta", 12)]
    assert got["bullets"] == [("Backend Engineer", "Acme", 77), ("Data Engineer", "Beta", 24)]
    assert got["dates"] == [("Some words first", None, None), ("Analyst", None, 10)] and got["sentence"] == [("Wrote many things", None, None)]
    assert got["none"] == got["no title"] == [] and got["listed"] == [("First thing", None, None), ("Second thing", None, None)]
    assert got["wrong order"] == [("Cook", "Inn", None)] and len(got) == len(texts)


def test_parsed_queries_and_provider(spark):
    jobs = spark.createDataFrame([("j", "Senior Engineer", "We build search. Required: Python, SQL. Tea is served.", [], [], None, None)], "id string, title string, raw_description string, must_have_skills array<string>, nice_to_have_skills array<string>, seniority string, location string")
    r = parse.parsed_queries(jobs).first()
    assert (r.seniority, r.must_have, r.responsibilities) == ("senior", ["Python", "SQL"], ["We build search."])

    def provider(prompt):
        if "previous answer" not in prompt:
            return "{broken"
        return '{"must_have": ["Python", "FastAPI"]}'

    assert parse.parsed_with_provider(jobs, provider).first().must_have == ["Python", "FastAPI"]


def test_leaders_are_not_transitive(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    pairs = spark.createDataFrame([("a", "b", 1, 2), ("b", "c", 2, 3)], "a string, b string, order_a int, order_b int")
    got = {r.id: r.near_duplicate_of for r in tables.leaders(rows, pairs, "id").collect()}
    assert got == {"a": None, "b": "a", "c": None}


def test_near_duplicate_pairs_find_what_all_pairs_find(spark):
    from rankloom.functions.text import token_set_ratio

    base = "the quick brown fox jumps over the lazy dog and runs through the long green grass near the old river bank today"
    texts = [base, base + " again", base.replace("quick", "quik"), "one two three", "three two one", "", base.upper(), "alpha beta gamma delta"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").withColumn("n", F.col("id"))
    got = {(r.a, r.b) for r in tables.near_duplicate_pairs(df, "id", "t", "n").collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and token_set_ratio(texts[i], texts[j]) >= 99}
    assert got == want and want
    # Texts of few, long tokens of which each has an edit share no token.
    r = random.Random(8)
    long = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (123, 200, 260)] + ["a" * 150]
    edited = [f"{t[:2]}z{t[3:]}" for t in long] + [f"{t[:-1]}y" for t in long] + [f"x{long[0]}q {long[1]}q x{long[2]}", f"{long[0]} {long[1]} {long[2]}", long[0][::-1]]
    texts = long + edited
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").withColumn("n", F.col("id"))
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if token_set_ratio(texts[i], texts[j]) >= 99}
    assert {(r.a, r.b) for r in tables.near_duplicate_pairs(df, "id", "t", "n").collect()} == want and len(want) >= 10


def test_deduplicated_is_the_greedy_pass(spark):
    from rankloom.functions.text import token_set_ratio

    r = random.Random(9)
    base = [" ".join(r.choice(["red", "green", "blue", "gold", "pink", "grey", "teal", "lime"]) + str(r.randint(0, 30)) for _ in range(60)) for _ in range(6)]
    texts = [*base, "", " "]
    for _ in range(40):
        t = r.choice(texts[:6])
        texts.append(r.choice([t, t[:5] + "x" + t[6:], t + " more", " ".join(t.split()[:-1]), t.replace("a", "e", 1)]))
    rows = spark.createDataFrame([(f"k{i}", t, i) for i, t in enumerate(texts)] + [("k3", "again", 99)], "id string, t string, at int")
    stays = []
    for i, t in enumerate(texts):
        if not any(t.strip() and token_set_ratio(t, texts[j]) >= 99 for j in stays):
            stays.append(i)
    stay, gone = tables.deduplicated(rows, "id", "t", "at")
    assert {r.id for r in stay.collect()} == {f"k{i}" for i in stays} and len(stays) < len(texts)
    reasons = {(r.id, r.at): (r.reason, r.near_of) for r in gone.collect()}
    assert reasons.pop(("k3", 99)) == ("duplicate_id", None) and len(reasons) == len(texts) - len(stays)
    for (k, _), (why, near_of) in reasons.items():
        of = int(near_of.removeprefix("k"))
        assert why == "near_duplicate_text" and of in stays and token_set_ratio(texts[int(k[1:])], texts[of]) >= 99
    assert all(df.columns[:3] == rows.columns for df in (stay, gone))


def test_rules_of_the_second_ranker(spark):
    e = "array<struct<title:string,company:string,description:string>>"
    df = spark.createDataFrame([([("Engineering Manager", "TCS", "Led search with embeddings in production")], ["faiss"])], f"entries {e}, skills array<string>")
    t = rules.TextOf(F.col("entries"), F.col("skills"))
    good = rules.positives_b(t, F.lit("Pune"), F.lit(None).cast("boolean"), F.lit(15), F.lit(None).cast("string"), F.lit(None).cast("double"))
    bad = rules.negatives_b(t, F.lit(6.0), F.lit(20), F.lit(3), F.lit(None).cast("double"))
    r = df.select(rules.count_true(good).alias("n"), flags(bad).alias("b")).first()
    assert r.n == 4
    assert r.b == ["disqualifier_lead_no_coding", "disqualifier_job_hopper", "disqualifier_consulting_only", "disqualifier_closed_source_only"]


def test_inconsistencies(spark):
    s = "array<struct<name:string,proficiency:string,endorsements:int,duration_months:int>>"
    df = spark.createDataFrame([(1, [("Python", "expert", 1, 0)], 48, 5.0), (2, [("Go", "expert", 1, 1)], 120, 5.0), (3, [("Go", "expert", 1, 30)], 48, 4.0)], f"id int, skills {s}, total_career_months int, years_of_experience double")
    a = {r.id: r.f for r in df.select("id", records.inconsistencies_a().alias("f")).collect()}
    assert a == {1: ["expert_zero_duration:Python"], 2: ["expert_zero_duration:Go", "experience_mismatch"], 3: []}
    history = F.array(F.struct(F.col("total_career_months").alias("duration_months")))
    b = {r.id: len(r.f) for r in df.select("id", records.inconsistencies_b(F.col("skills"), history, F.col("years_of_experience")).alias("f")).collect()}
    assert b == {1: 1, 2: 1, 3: 0}


def test_postings_and_vocabulary(spark):
    from collections import Counter

    from rankloom.functions.text import FORM_A

    texts = ["b a b c b", "", None, "x", "a a", "É e.e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    words = {i: [w.decode() for w in FORM_A.terms(t)] for i, t in enumerate(texts)}
    got = {(r.id, r.term): (r.tf, r.dl) for r in index.postings(df, "id", "t", FORM_A).collect()}
    assert got == {(i, w): (n, len(ws)) for i, ws in words.items() for w, n in Counter(ws).items()}
    vocab = {r.term: (r.df, r.cf, r.max_tf) for r in index.vocabulary(df, "t", FORM_A).collect()}
    assert vocab == {None: (6, 10, 5), "a": (2, 3, 2), "b": (1, 3, 3), "c": (1, 1, 1), "x": (1, 1, 1), "e": (1, 2, 2)}
    assert {r.term for r in index.vocabulary(df, "t", FORM_A, frozenset([b"a", b"q"])).collect()} == {None, "a"}


def test_nearest_neighbours_are_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(index, "QUERY_BLOCK", 3)
    r = random.Random(3)
    vectors = [[float(r.randint(-2, 2)) for _ in range(3)] for _ in range(60)] + [[0.0, 0.0, 0.0], None]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(vectors)], "id int, v array<float>, side int").repartition(5)
    asked = spark.createDataFrame([(i, vectors[i]) for i in (0, 7, 20, 33, 60)], "q int, w array<float>")

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a or ())) * math.sqrt(sum(x * x for x in b or ()))
        return round(sum(x * y for x, y in zip(a, b)) / size, 9) if size else 0.0

    for keep, some in ((None, range(62)), (F.col("side") == 1, range(1, 62, 2))):
        got: dict = {}
        for row in index.knn(df, asked, "id", "v", "q", "w", 7, keep).collect():
            got.setdefault(row.q, {})[row.id] = row.score
        for q in (0, 7, 20, 33, 60):
            want = sorted((-cosine(vectors[i], vectors[q]), i) for i in some)[:7]
            assert got[q] == {i: pytest.approx(-s) for s, i in want}
    assert index.knn(df, asked.limit(0), "id", "v", "q", "w", 7).count() == 0 and index.knn(df.limit(0), asked, "id", "v", "q", "w", 7).count() == 0


def test_only_small_tables_are_broadcast(spark):
    from rankloom.operators.sizes import small

    df = spark.range(1000).select(F.col("id").cast("string").alias("s"))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(df)) and not hinted(small(df, 1000))


def test_fixed_rounds_the_binary_value(spark):
    rng = random.Random(5)
    values = [k / 200 for k in range(-41, 400)] + [k / 1000 for k in range(0, 3000, 7)] + [rng.random() * 10 ** rng.randint(-4, 5) for _ in range(500)] + [5e5 + 0.125, 0.0, 1e-12, 99.95, 2.0**20 - 0.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[explain.fixed(F.col("v"), n).alias(f"f{n}") for n in (1, 2)]).collect()
    assert [(r.f1, r.f2) for r in rows] == [(f"{r.v:.1f}", f"{r.v:.2f}") for r in rows]


def test_company_names_that_end_in_a_number(spark):
    texts = {1: "Engineer at Acme 1000, Jan 2015 - Feb 2018", 2: "Engineer at Acme 31415 | 2015 to Present", 3: "Engineer at Acme, 2015 - 2018", 4: "Engineer at Acme, Jan 2015"}
    docs = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {r.id: r.experience_entries[0].company for r in parse.experience(docs, "id", "t", "2026-06-17").collect()}
    assert got == {1: "Acme 1000", 2: "Acme 31415", 3: "Acme", 4: "Acme"}


def test_distances_do_not_pair_the_nodes_of_a_hub(spark, monkeypatch):
    made, whole = [], graph.met_at
    monkeypatch.setattr(graph, "met_at", lambda *a: (lambda df: (made.append(df.count()), df)[1])(whole(*a)))
    edges = spark.createDataFrame([(f"c{i}", "hub") for i in range(200)] + [("hub", "far")], "src string, dst string")
    nodes = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    got = {(r.src, r.dst): r.distance for r in graph.distances(edges, nodes([f"c{i}" for i in range(200)]), nodes(["hub", "far"]), 3).collect()}
    assert got == {(f"c{i}", d): n for i in range(200) for d, n in (("hub", 1), ("far", 2))} and max(made) < 2000


def test_pieces_of_a_hub_are_dealt_to_tasks(spark):
    side = lambda c: spark.range(40).select(F.lit(1).alias("node"), F.col("id").alias(c))
    met = graph.met_at(side("a"), side("b"), "node", 10)
    assert met.count() == 1600 and max(r.n for r in met.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) < 1600


def test_nearest_vectors_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    q, rows = rng.normal(size=(2048, 4)), rng.normal(size=(6000, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000, 0, -1), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    tracemalloc.start()
    of, ids, scores = index.nearest([batch], q, 3, 2, pa.int64())
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
    unit = np.round(q @ index.unit(batch.column(1)).T, 2)
    for i in range(0, 2048, 97):
        want = sorted(zip(-unit[i], range(6000, 0, -1)))[:3]
        assert [(-s, v) for o, v, s in zip(of, ids.to_pylist(), scores) if o == i] == [(pytest.approx(s), v) for s, v in want]


def test_heads_leave_out_what_no_list_can_hold(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))) for i in range(400)], "d int, t string").coalesce(1)
    asked = spark.createDataFrame([(1, "a b"), (2, "f"), (3, "zz")], "q int, t2 string")
    order = [F.desc("score"), F.asc("d")]
    for bm25 in (index.bm25_a, index.bm25_b):
        whole, some = (bm25(docs, asked, "d", "t", "q", "t2", first).withColumn("score", F.round("score", 6)) for first in (None, 5))
        assert sorted(index.top_k(some, 5, "q", order).collect()) == sorted(index.top_k(whole, 5, "q", order).collect())
        assert bm25 is index.bm25_b or some.count() < whole.count()


def test_keyword_lists_are_cut_where_documents_are(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 9)))) for i in range(300)], "d int, t string").coalesce(1)
    asked = spark.createDataFrame([(1, "a b B c d e"), (2, "f g h"), (3, "zz")], "q int, t2 string")
    words = lambda df, c: df.withColumn("w", F.split(F.lower(c), " "))
    whole = index.keyword_overlap(words(docs, "t"), words(asked, "t2"), "d", "w", "q", "w")
    some = index.keyword_lists(docs, asked, "d", "t", "q", "t2", 4)
    order = [F.desc("overlap"), F.asc("d")]
    assert sorted(index.top_k(some, 4, "q", order).collect()) == sorted(index.top_k(whole, 4, "q", order).collect()) and some.count() < whole.count()


def test_roles_are_read_once(spark):
    rows = spark.createDataFrame([(1, "Engineer at Acme, Jan 2020 - Present\nBuilt things"), (2, "-")], "id int, t string")
    found = parse.experience(rows, "id", "t", "2026-06-17")
    assert {r.id: [x.title for x in r.experience_entries] for r in found.collect()} == {1: ["Engineer"], 2: []}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "@| at " in line]


def test_dense_vectors_are_the_sums_of_hashed_tokens_and_need_no_shuffle(spark):
    texts = ["c++ c# .net C++ a b", "", None, "É x.y Z", " ".join(f"w{i % 37}" for i in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    cells: dict = {}
    for r in embed.sparse(df, "id", F.col("t"), 16).collect():
        cells.setdefault(r.id, [0.0] * 16)[r.bucket] = r.value
    made = embed.dense(df, "id", F.col("t"), 16)
    for r in made.collect():
        size = math.sqrt(sum(x * x for x in cells.get(r.id, [])))
        assert r.vector == (pytest.approx([x / size for x in cells[r.id]], rel=1e-6) if size else [0.0] * 16)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_scores_and_counts_do_not_depend_on_the_size_of_a_step(spark, monkeypatch):
    from rankloom.functions.text import FORM_B

    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "b", "c", "D", "e#", "zz"]) for _ in range(r.randint(0, 30))) for _ in range(60)] + [None, "", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    asked = spark.createDataFrame([(1, "a b b"), (2, "e# d q"), (3, "qq"), (4, None)], "q int, w string")
    told = lambda: {(x.q, x.id): x.score for x in index.bm25_b(docs, asked, "id", "t", "q", "w").collect()}
    counts = lambda: {x.term: (x.df, x.cf, x.max_tf) for x in index.vocabulary(docs, "t", FORM_B).collect()}
    scores, vocab = told(), counts()
    monkeypatch.setattr(index, "SCORES", 4)
    monkeypatch.setattr(index, "FLUSH", 3)
    assert counts() == vocab and told() == pytest.approx(scores)
    n, length = vocab[None][0], vocab[None][1]
    raw = {w: math.log(n - df + 0.5) - math.log(df + 0.5) for w, (df, _, _) in vocab.items() if w}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    want = {}
    for i, t in enumerate(texts):
        words = [w.decode() for w in FORM_B.terms(t)]
        for q, query in ((1, ["a", "b", "b"]), (2, ["e#", "d", "q"])):
            if any(w in words for w in query):
                want[q, i] = sum(idf[w] * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) * n / length)) for w in query if w in words)
    assert scores == pytest.approx(want)


def test_roles_are_read_in_one_pass_over_the_text(spark):
    rows = spark.createDataFrame([("1", "- Cook at Acme, 2019 - 2020\n- Ran 2021 to Present"), ("2", "<b>\n\nmade soup"), ("3", "<b>"), ("4", None)], "id string, t string")
    found = parse.experience(rows, "id", "t", "2026-06-01")
    assert {r.id: [(e.title, e.start, e.end) for e in r.experience_entries] for r in found.collect()} == {"1": [("Cook", " 2019", "2020"), ("Ran", " 2021", "Present")], "2": [("made soup", None, None)], "3": [], "4": []}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "Window" not in plan
