import json

import pytest
from pyspark.sql import functions as F

from rankloom.operators import records
from rankloom.plans import first_ranker, ingest, second_ranker
from rankloom.plans.store import Store
from rankloom.sources import readers, writers
from rankloom.streaming import activity


def record(n, **over):
    base = {
        "candidate_id": f"CAND_{n:07d}",
        "profile": {"anonymized_name": "A", "headline": "Engineer", "summary": "Builds retrieval and ranking systems in production", "location": "Pune", "country": "India", "years_of_experience": 4.0, "current_title": "ML Engineer", "current_company": "Acme", "current_company_size": "51-200", "current_industry": "Software"},
        "career_history": [{"company": "Acme", "title": "NLP Engineer", "start_date": "2020-01-01", "end_date": None, "duration_months": 36, "is_current": True, "industry": "Software", "company_size": "51-200", "description": "Deployed NLP search"}],
        "education": [{"institution": "U", "degree": "BSc", "field_of_study": "CS", "start_year": 2010, "end_year": 2014, "grade": None, "tier": "tier_1"}],
        "skills": [{"name": "Python", "proficiency": "advanced", "endorsements": 3, "duration_months": 24}],
        "certifications": [], "languages": [],
        "signals": {"profile_completeness_score": 90.0, "signup_date": "2024-01-01", "last_active_date": "2026-06-01", "open_to_work_flag": True, "profile_views_received_30d": 1, "applications_submitted_30d": 1, "recruiter_response_rate": 0.9, "avg_response_time_hours": 2.0, "skill_assessment_scores": {"Python": 80.0}, "connection_count": 10, "endorsements_received": 5, "notice_period_days": 15, "expected_salary_range_inr_lpa": {"min": 1.0, "max": 2.0}, "preferred_work_mode": "remote", "willing_to_relocate": True, "github_activity_score": 40.0, "search_appearance_30d": 1, "saved_by_recruiters_30d": 1, "interview_completion_rate": 0.8, "offer_acceptance_rate": -1.0, "verified_email": True, "verified_phone": True, "linkedin_connected": True},
    }
    for key, value in over.items():
        block, _, field = key.partition("__")
        if field:
            base[block] = base[block] | {field: value}
        else:
            base[block] = value
    return base


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "records.jsonl"
    rows = [record(1), record(2, profile__years_of_experience=70.0), record(3, skills=[{"name": "Go", "proficiency": "expert", "endorsements": 0, "duration_months": 0}]), record(4, signals__github_activity_score=None), record(5, career_history=[])]
    path.write_text("\n".join(json.dumps(r) for r in rows[:2]) + "\n\n" + "\n".join(json.dumps(r) for r in rows[2:]) + "\n")
    return str(path)


def test_first_ranker(spark, lines):
    top, bad = first_ranker.from_records(readers.json_lines(spark, lines))
    got = top.orderBy("rank").collect()
    assert [(r.candidate_id, r["rank"]) for r in got] == [("CAND_0000001", 1), ("CAND_0000003", 2)]
    assert got[1].score == 0 and got[1].flagged and got[0].score > 0.3
    assert got[0].reasoning.startswith("ML Engineer, 4.0 yrs experience; hands-on production")
    assert {(r.record_id, r.reason) for r in bad.collect()} == {("CAND_0000002", "profile.years_of_experience"), ("CAND_0000004", "signals.github_activity_score"), ("CAND_0000005", "career_history")}


def test_numbered_lines_and_the_second_form(spark, lines):
    rows = readers.numbered_lines(spark, lines, records.record_schema())
    assert [(r.row_index, r.candidate_id) for r in rows.orderBy("row_index").collect()] == [(0, "CAND_0000001"), (1, "CAND_0000002"), (3, "CAND_0000003"), (4, "CAND_0000004"), (5, "CAND_0000005")]
    parts = ingest.from_records(spark, lines)
    flat = parts["candidates"].orderBy("id").first()
    assert (flat.total_career_months, flat.num_employers, flat.current_role_ai_relevant, flat.skills_raw) == (36, 1, True, ["Python"])
    assert flat.raw_resume_text.startswith("Engineer\n\nSummary: Builds") and flat.raw_resume_text.endswith("Skills: Python")
    assert {r.row_index for r in parts["rejected"].collect()} == {1, 4, 5}
    assert "profile" in parts["rejected"].filter("row_index = 1").first().reason


def test_every_row_is_accepted_or_refused(spark, tmp_path):
    c = "candidate_id,resume,skills,years_experience\n" + "".join(f'c{i},"Engineer number {i} wrote code {i * 7}","Python, ML",{i}\n' for i in range(1, 11)) + "c11,,Python,1\nc1,Again,Python,1\n"
    j = "job_id,job_title,description,required_skills,preferred_skills\n" + "".join(f'j{i},Engineer,"A long enough description {i}",Python,SQL\n' for i in range(1, 8)) + "j8,Engineer,Too short,Python,SQL\n"
    (tmp_path / "candidates.csv").write_text(c)
    (tmp_path / "jobs.csv").write_text(j)
    paths = [readers.discovered(spark, str(tmp_path), n) for n in ("candidates", "jobs")]
    parts = ingest.from_tables(*[readers.table(spark, p) for p in paths])
    assert {r.name: r.n for r in ingest.counts(parts).collect()} == {"candidates": 10, "jobs": 7, "rejected": 3}
    assert {r.record_type for r in parts["rejected"].collect()} == {"candidate", "job"}
    first = parts["candidates"].filter("id = 'c1'").first()
    assert first.skills_raw == ["Python", "ML"] and first.experience_years == 1.0


def test_readers_refuse_what_they_cannot_read(spark, tmp_path):
    with pytest.raises(readers.UnsupportedFormat):
        readers.table(spark, str(tmp_path / "x.xml"))
    with pytest.raises(readers.SourceNotFound):
        readers.table(spark, str(tmp_path / "x.csv"))


def test_document_text(spark, tmp_path):
    import zipfile

    path = tmp_path / "a.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p><w:r><w:t xml:space='preserve'>three</w:t></w:r></w:p></w:document>")
    assert readers.documents(spark, str(path)).first().text == "One & two\nthree"


@pytest.fixture(scope="module")
def people(spark):
    entities = spark.createDataFrame([("c1", "Skills\nPython, FastAPI, Qdrant\nExperience\nSenior Engineer at Acme, Jan 2018 - Mar 2022\n- Built search with embeddings in production.", ["Python", "FastAPI", "Qdrant"], 6.0, "Bengaluru", None), ("c2", "Skills\nJava\nExperience\nEngineer at Beta, 2019 - 2020", ["Java"], 2.0, "Bengaluru", None), ("c3", "Python and fast api work", ["python3", "fast api"], None, None, "https://x.org/y")], "id string, raw_resume_text string, skills_raw array<string>, experience_years double, location string, github_url string")
    jobs = spark.createDataFrame([("j1", "Senior Search Engineer", "We build search with Python and FastAPI for users.", ["Python"], ["Qdrant"], "senior", "Bengaluru")], "id string, title string, raw_description string, must_have_skills array<string>, nice_to_have_skills array<string>, seniority string, location string")
    return entities, jobs


def test_second_ranker_and_store(spark, people, tmp_path):
    entities, jobs = people
    store = Store(spark, str(tmp_path))
    with pytest.raises(second_ranker.NotFound):
        store.rank("j1")
    store.save("jobs", jobs)
    with pytest.raises(second_ranker.NotFound):
        store.rank("j1")
    store.save("candidates", entities)
    store.save("candidates", entities.filter("id = 'c2'").withColumn("experience_years", F.lit(3.0)))
    assert store.table("candidates").count() == 3 and store.one("candidates", "c2").first().experience_years == 3.0
    with pytest.raises(second_ranker.NotFound):
        store.rank("nobody")
    got = store.rank("j1", dim=64).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and {r.candidate_id for r in got} == {"c1", "c3"}
    top = next(r for r in got if r.candidate_id == "c1")
    assert top.matched_points and top.missing_points == [] and "for the 'Senior Search Engineer' role" in top.narrative
    assert top.skill_overlap == pytest.approx(2 / 3) and top.kg_skill_distance == 1 and top.seniority_match == 1
    again = store.rank("j1", dim=64).collect()
    assert len(again) == len(got) == store.results("j1").count()


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5, "x", {"k": 1.0}), ("b", 2, 0.4, "y", None)], "candidate_id string, rank int, score double, reasoning string, m map<string,double>")
    writers.result_csv(rows, str(tmp_path / "r"))
    assert [r.candidate_id for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == ["a", "b"]
    assert writers.flat(rows).schema["m"].dataType.typeName() == "string"
    writers.json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    lists = writers.per_query(rows.withColumn("q", F.lit(1)).select("q", "rank", "candidate_id"), "q", "rank").first().results
    assert [x.candidate_id for x in lists] == ["a", "b"]


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type", "value")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = activity.windowed(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    want = {(r.user_id, r.start, r.n) for r in activity.windowed(events).collect()}
    assert {(r.user_id, r.start, r.n) for r in spark.table("streamed").collect()} == want and want
    assert activity.sessions(events).count() > 0
