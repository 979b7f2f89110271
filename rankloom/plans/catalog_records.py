"""Named queries over nested records, with their SQL: validators, flattening, rule tables and the first ranker itself.

The driver's tables hold no such records, so each document stands for one: its id picks words from the rules' own lists,
companies, titles, numbers and faults by remainders, the same in Spark and in SQL. All rows of documents take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import vocab as V
from rankloom.functions.text import flags
from rankloom.operators import explain, records, rules
from rankloom.plans import first_ranker

_LISTS = sorted(k for k in vars(V) if k[:2] in ("A_", "B_"))
TERMS = sorted({w.strip() for k in _LISTS for w in getattr(V, k)}) + ["cooked meals", "drove a lorry", "painted walls", "taught music"] * 8
COMPANIES = [*V.A_CONSULTING, "Acme", "Beta Works", "Delta", "Gamma Foods", "Omega"]
TITLES = ["Cook", "Data Scientist", "Director", "Engineer", "Head of Search", "NLP Researcher", "PhD student", "Software Architect", "Tech Lead", "Writer"]
PLACES = ["Bergen", "Delhi NCR", "Oslo", "Pune, India"]
SIZES, MODES, TIERS = [*V.COMPANY_SIZES, "huge"], [*V.WORK_MODES, "moon"], [*V.EDUCATION_TIERS, "tier_9"]
JOBS = 4


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def nested(documents: DataFrame) -> DataFrame:
    """Records in the schema of `records.record_schema`, one for each doc_id; doc_id stays."""
    d = F.col("doc_id")

    def job(j: Column) -> Column:
        return F.struct(
            _pick(COMPANIES, d * 3 + j * 5).alias("company"), _pick(TITLES, d * 7 + j * 3).alias("title"), F.concat((2008 + (d * 5 + j * 7) % 16).cast("string"), F.lit("-01-01")).alias("start_date"), F.lit(None).cast("string").alias("end_date"),
            ((d * 11 + j * 13) % 45).cast("int").alias("duration_months"), (j == d % 3).alias("is_current"), F.lit("Software").alias("industry"), _pick(SIZES, F.greatest(d + j, F.lit(0)) * 5).alias("company_size"), _pick(TERMS, d * 13 + j * 17).alias("description"),
        )

    def skill(j: Column) -> Column:
        level = F.when((d * 3 + j) % 17 == 0, "guru").otherwise(_pick(V.PROFICIENCIES, d + j))
        return F.struct(_pick(TERMS, d * 19 + j * 23).alias("name"), level.alias("proficiency"), F.lit(1).alias("endorsements"), F.when((d + j) % 7 != 0, ((d + j * 2) % 4 * 6).cast("int")).alias("duration_months"))

    profile = F.struct(
        F.lit("A").alias("anonymized_name"), _pick(TERMS, d * 3 + 1).alias("headline"), F.concat(_pick(TERMS, d * 5 + 2), F.lit(" and "), _pick(TERMS, d * 9 + 4)).alias("summary"), _pick(PLACES, d).alias("location"), _pick(["India", "Norway", "Norway"], d).alias("country"),
        F.when(d % 101 == 0, 70.0).otherwise((d % 23).cast("double")).alias("years_of_experience"), _pick(TITLES, d).alias("current_title"), _pick(COMPANIES, d).alias("current_company"), _pick(SIZES, d).alias("current_company_size"), _pick(["Software", "HR services", "Retail"], d).alias("current_industry"),
    )
    signals = {
        "profile_completeness_score": F.lit(50.0), "signup_date": F.lit("2024-01-01"), "last_active_date": F.lit("2026-06-01"), "open_to_work_flag": d % 2 == 1, "profile_views_received_30d": F.lit(1), "applications_submitted_30d": F.lit(1),
        "recruiter_response_rate": (d % 11).cast("double") / 10, "avg_response_time_hours": F.lit(2.0), "skill_assessment_scores": F.create_map(F.lit("x"), F.lit(1.0)), "connection_count": F.lit(1), "endorsements_received": (d % 9).cast("int"), "notice_period_days": ((d * 7) % 200).cast("int"),
        "expected_salary_range_inr_lpa": F.struct(F.lit(1.0).alias("min"), F.lit(2.0).alias("max")), "preferred_work_mode": _pick(MODES, d * 2), "willing_to_relocate": d % 2 == 0, "github_activity_score": (d % 120).cast("double") - 1, "search_appearance_30d": F.lit(1), "saved_by_recruiters_30d": F.lit(1),
        "interview_completion_rate": F.lit(0.5), "offer_acceptance_rate": F.when(d % 4 == 0, -1.0).otherwise((d % 10).cast("double") / 10), "verified_email": d % 3 != 0, "verified_phone": d % 4 != 0, "linkedin_connected": F.lit(True),
    }
    some = lambda n, of: F.transform(F.filter(F.array(*[F.lit(k).cast("long") for k in range(JOBS)]), lambda j: j < n), of)
    school = F.struct(F.lit("U").alias("institution"), F.lit("BSc").alias("degree"), F.lit("CS").alias("field_of_study"), F.lit(2010).alias("start_year"), F.lit(2014).alias("end_year"), F.lit(None).cast("string").alias("grade"), _pick(TIERS, d).alias("tier"))
    rows = documents.select(
        d, F.concat(F.when(d % 13 == 0, "ID_").otherwise("CAND_"), F.lpad(d.cast("string"), 7, "0")).alias("candidate_id"), profile.alias("profile"), some(d % 5, job).alias("career_history"), F.array(school).alias("education"), some(F.lit(3), skill).alias("skills"),
        F.array().cast("array<struct<name:string,issuer:string,year:int>>").alias("certifications"), F.array().cast("array<struct<language:string,proficiency:string>>").alias("languages"), F.struct(*[c.alias(k) for k, c in signals.items()]).alias("signals"),
    )
    return rows


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: list[str], at: str) -> str:
    return f"{_sql_list(values)}[(({at}) % {len(values)} + 1)::INT]"


def any_of(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '" + w.replace("'", "''") + "')" for w in words) + ")"


RECORDS = f"""
rec AS (SELECT doc_id AS d, CASE WHEN doc_id % 13 = 0 THEN 'ID_' ELSE 'CAND_' END || lpad(doc_id::VARCHAR, 7, '0') AS candidate_id,
  {_sql_pick(TERMS, 'doc_id * 3 + 1')} AS headline, {_sql_pick(TERMS, 'doc_id * 5 + 2')} || ' and ' || {_sql_pick(TERMS, 'doc_id * 9 + 4')} AS summary, {_sql_pick(PLACES, 'doc_id')} AS location, {_sql_pick(['India', 'Norway', 'Norway'], 'doc_id')} AS country,
  CASE WHEN doc_id % 101 = 0 THEN 70 ELSE doc_id % 23 END::DOUBLE AS years, {_sql_pick(TITLES, 'doc_id')} AS current_title, {_sql_pick(SIZES, 'doc_id')} AS size, {_sql_pick(['Software', 'HR services', 'Retail'], 'doc_id')} AS industry,
  list_transform(list_filter([0, 1, 2, 3], lambda j: j < doc_id % 5), lambda j: {{'start_date': (2008 + (doc_id * 5 + j * 7) % 16) || '-01-01', 'company': {_sql_pick(COMPANIES, 'doc_id * 3 + j * 5')}, 'title': {_sql_pick(TITLES, 'doc_id * 7 + j * 3')},
    'months': (doc_id * 11 + j * 13) % 45, 'now': j = doc_id % 3, 'size': {_sql_pick(SIZES, '(doc_id + j) * 5')}, 'description': {_sql_pick(TERMS, 'doc_id * 13 + j * 17')}}}) AS h,
  list_transform([0, 1, 2], lambda j: {{'name': {_sql_pick(TERMS, 'doc_id * 19 + j * 23')}, 'level': CASE WHEN (doc_id * 3 + j) % 17 = 0 THEN 'guru' ELSE {_sql_pick(V.PROFICIENCIES, 'doc_id + j')} END, 'months': CASE WHEN (doc_id + j) % 7 <> 0 THEN (doc_id + j * 2) % 4 * 6 END}}) AS skills,
  {_sql_pick(TIERS, 'doc_id')} AS tier, (doc_id * 7) % 200 AS notice, {_sql_pick(MODES, 'doc_id * 2')} AS mode, doc_id % 2 = 0 AS willing, (doc_id % 120 - 1)::DOUBLE AS github, CASE WHEN doc_id % 4 = 0 THEN -1.0 ELSE (doc_id % 10) / 10 END AS offers, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS verified
  FROM documents)"""

_BAD_SKILL = f"len(list_filter(skills, lambda x: NOT list_contains({_sql_list(V.PROFICIENCIES)}, x.level))) > 0"
_BAD_JOBS = f"len(list_filter(h, lambda x: NOT list_contains({_sql_list(V.COMPANY_SIZES)}, x.size))) > 0"
FAULTS_A = {
    "candidate_id": "NOT regexp_full_match(candidate_id, 'CAND_[0-9]{7}')", "profile.current_company_size": f"NOT list_contains({_sql_list(V.COMPANY_SIZES)}, size)", "profile.years_of_experience": "years > 50", "career_history": "len(h) = 0",
    "career_history.company_size": _BAD_JOBS, "education.tier": "tier = 'tier_9'", "skills.proficiency": _BAD_SKILL, "signals.preferred_work_mode": "mode = 'moon'", "signals.github_activity_score": "github > 100", "signals.notice_period_days": "notice > 180",
}
#: The second form's faults in their order, of those that these records can have.
FAULTS_B = {
    "candidate_id": FAULTS_A["candidate_id"], "profile.years_of_experience.range": "years > 50", "signals.notice_period_days.range": "notice > 180", "signals.github_activity_score.range": "github > 100",
    "profile.current_company_size.value": FAULTS_A["profile.current_company_size"], "signals.preferred_work_mode.value": "mode = 'moon'", "career_history": f"len(h) = 0 OR {_BAD_JOBS}", "education": "tier = 'tier_9'", "skills.item": _BAD_SKILL,
}


def _names(conditions: dict[str, str]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for n, c in conditions.items()) + ")"


FLAT_A = f"""{RECORDS},
flat AS (SELECT *, list_transform(h, lambda x: trim(x.company)) AS employers, list_sum(list_transform(h, lambda x: x.months)) AS months, coalesce(list_filter(h, lambda x: x.now)[1], h[-1]) AS cur,
  array_to_string(list_concat([headline, summary], flatten(list_transform(h, lambda x: [x.title, x.description]))), ' ') AS all_text, list_sort(h) AS by_start FROM rec WHERE {_names(FAULTS_A)} = ''),
ruled AS (SELECT *, lower(all_text) AS t, by_start[-1] AS last FROM flat)"""

_SAID = "lower(x.title || ' ' || x.description)"
_OPEN = any_of("t", V.A_OPEN_SOURCE)
NEGATIVES_A = {
    "consulting_only": f"len(employers) > 0 AND len(list_filter(employers, lambda e: NOT {any_of('lower(e)', V.A_CONSULTING)})) = 0",
    "pure_research_only": f"{any_of('t', V.A_RESEARCH)} AND NOT {any_of('t', V.A_PRODUCTION)}",
    "recent_ai_only": f"{any_of(_SAID.replace('x.', 'last.'), V.A_RECENT_AI)} AND last.months <= 12 AND len(list_filter(by_start[:-2], lambda x: {any_of(_SAID, V.A_RECENT_AI)})) = 0",
    "architect_no_recent_code": f"{any_of('lower(current_title)', V.A_LEAD_TITLES)} AND cur.months >= 18 AND NOT {any_of('lower(cur.description)', V.A_CODING)}",
    "job_hopper": "len(h) >= 3 AND months / len(h) < 18",
    "cv_speech_robotics_only": f"{any_of('t', V.A_VISION_SPEECH)} AND NOT {any_of('t', V.A_LANGUAGE)}",
    "closed_source_no_validation": f"years >= 5 AND NOT (github > 10 OR {_OPEN})",
}
POSITIVES_A = {
    "production_retrieval_experience": any_of("t", V.A_RETRIEVAL), "eval_framework_experience": any_of("t", V.A_EVALUATION), "hr_tech_exposure": f"{any_of('t', V.A_HIRING)} OR contains(lower(industry), 'hr')",
    "open_source_validation": f"github > 30 OR {_OPEN}", "india_or_relocate": "country = 'India' OR willing",
}
_INCONSISTENT_A = "len(list_filter(skills, lambda x: x.level = 'expert' AND coalesce(x.months, 0) <= 1)) > 0 OR months / 12 > years + 3"

FLAT_B = f"""{RECORDS},
told AS (SELECT *, list_transform(h, lambda x: lower(x.title || ' ' || x.company || ' ' || x.description)) AS each, list_transform(skills, lambda x: lower(trim(x.name))) AS s, list_sum(list_transform(h, lambda x: x.months)) AS months FROM rec WHERE {_names(FAULTS_B)} = ''),
ruled AS (SELECT *, array_to_string(each, ' ') AS t FROM told)"""


def _anywhere(words: list[str]) -> str:
    return f"({any_of('t', words)} OR list_has_any(s, {_sql_list(words)}))"


_EMPLOYERS = "len(list_distinct(list_transform(h, lambda x: lower(trim(x.company)))))"
POSITIVES_B = {
    "embedding_production": f"{_anywhere(V.B_EMBEDDING)} AND {any_of('t', V.B_PRODUCTION)}", "vector_store_production": f"{_anywhere(V.B_VECTOR_STORE)} AND {any_of('t', V.B_PRODUCTION)}", "evaluation": any_of("t", V.B_EVALUATION),
    "place": f"list_has_any(string_split_regex(lower(location), '[\\s,/;]+'), {_sql_list(V.B_PLACES)}) OR willing", "short_notice": "notice >= 0 AND notice < 30", "hiring_domain": any_of("t", V.B_HIRING), "open_work": any_of("t", V.B_OPEN_SOURCE),
}
NEGATIVES_B = {
    "disqualifier_pure_research": f"len(list_filter(h, lambda x: {any_of('lower(x.title)', V.B_ACADEMIC_TITLES)})) > 0 AND NOT {any_of('t', V.B_PRODUCTION)}",
    "disqualifier_recent_ai_only": f"{_anywhere(V.B_LLM)} AND NOT {_anywhere(V.B_CLASSIC)} AND years < 1",
    "disqualifier_lead_no_coding": f"{any_of('lower(h[1].title)', V.B_LEAD_TITLES)} AND NOT {any_of('each[1]', V.B_CODING)}",
    "disqualifier_job_hopper": f"months <> 0 AND {_EMPLOYERS} >= 3 AND months / {_EMPLOYERS} < 18",
    "disqualifier_consulting_only": f"len(list_filter(h, lambda x: NOT {any_of('lower(x.company)', V.B_CONSULTING)})) = 0",
    "disqualifier_cv_speech_robotics_only": f"{_anywhere(V.B_VISION_SPEECH)} AND NOT {_anywhere(V.B_LANGUAGE)}",
    "disqualifier_closed_source_only": f"years >= 5 AND github IN (-1, 0) AND NOT {any_of('t', V.B_OPEN_SOURCE)}",
}


def valid(rows: DataFrame, faults: Column) -> DataFrame:
    good, _ = records.split_valid(rows, faults, "documents", "candidate", "candidate_id", "doc_id")
    return good


def record_faults_a(rows: DataFrame) -> DataFrame:
    return nested(rows).select("doc_id", F.array_join(records.faults_a(), ";").alias("faults"))


def record_faults_b(rows: DataFrame) -> DataFrame:
    return nested(rows).select("doc_id", F.array_join(records.faults_b(), ";").alias("faults"))


def flat_a(rows: DataFrame) -> DataFrame:
    return records.flatten_a(valid(nested(rows), records.faults_a()))


def flat_b(rows: DataFrame) -> DataFrame:
    """Rows of the second form, with the nested parts that the rules read."""
    good = valid(nested(rows), records.faults_b())
    return records.flatten_b(good).join(good.select(F.col("candidate_id").alias("id"), "profile.location", "career_history", F.col("skills").alias("levels"), F.col("signals").alias("s")).withColumnsRenamed({"career_history": "history", "location": "place"}), "id")


def flattened_a(rows: DataFrame) -> DataFrame:
    f = flat_a(rows)
    return f.select("candidate_id", F.md5("all_text").alias("text_md5"), F.col("total_career_months").cast("long").alias("months"), F.array_join("employers", "|").alias("employers"), F.col("current_role_duration_months").cast("long").alias("current_months"), F.col("num_skills").cast("long").alias("n_skills"), F.col("num_expert_skills").cast("long").alias("n_expert"))


def flattened_b(rows: DataFrame) -> DataFrame:
    f = flat_b(rows)
    return f.select("id", F.md5("raw_resume_text").alias("text_md5"), F.array_join("skills_raw", "|").alias("skills"), "experience_years", F.col("total_career_months").cast("long").alias("months"), F.col("num_employers").cast("long").alias("employers"), F.col("current_role_ai_relevant").alias("relevant"))


def rubric_a(rows: DataFrame) -> DataFrame:
    negative = flags(rules.negatives_a())
    return flat_a(rows).select("candidate_id", F.array_join(flags(rules.positives_a()), ",").alias("positives"), F.array_join(negative, ",").alias("negatives"), rules.multiplier_a(negative).alias("multiplier"))


def rubric_b(rows: DataFrame) -> DataFrame:
    f = flat_b(rows)
    t = rules.TextOf(F.col("history"), F.transform("levels", lambda x: x["name"]))
    good = rules.positives_b(t, F.col("place"), F.col("s.willing_to_relocate"), F.col("s.notice_period_days"), F.lit(None).cast("string"), F.col("s.github_activity_score"))
    bad = rules.negatives_b(t, F.col("experience_years"), F.col("total_career_months"), F.col("num_employers"), F.col("s.github_activity_score"))
    return f.select("id", F.array_join(flags(good), ",").alias("positives"), F.array_join(flags(bad), ",").alias("negatives"))


def first_ranking(rows: DataFrame) -> DataFrame:
    """The first ranker on all records: its BM25, rules, composite, head of 100, ranks and reasons."""
    best, _ = first_ranker.from_records(nested(rows).drop("doc_id"))
    return best.select("candidate_id", F.col("rank").cast("long").alias("rank"), "score", "reasoning")


_TOKENS = "regexp_extract_all(t, '[a-z0-9]+')"
_PHRASES = lambda names, words: "[" + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '" + words[n].replace("'", "''") + "' END" for n, c in names.items()) + "]"
FIRST = f"""WITH {FLAT_A},
q AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{first_ranker.QUERY}'), '[a-z0-9]+')) AS term),
tok AS (SELECT candidate_id, unnest({_TOKENS}) AS term FROM ruled), st AS (SELECT count(*) AS n, sum(len({_TOKENS})) / count(*) AS avgdl FROM ruled), dl AS (SELECT candidate_id, len({_TOKENS}) AS dl FROM ruled),
tf AS (SELECT candidate_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT candidate_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (candidate_id), st GROUP BY ALL),
b AS (SELECT ruled.*, coalesce(bm, 0) AS bm, list_filter({_PHRASES(POSITIVES_A, explain.POSITIVE_PHRASES)}, lambda x: x IS NOT NULL) AS pos, list_filter({_PHRASES(NEGATIVES_A, explain.NEGATIVE_NOTES)}, lambda x: x IS NOT NULL) AS neg FROM ruled LEFT JOIN bm USING (candidate_id)),
s AS (SELECT *, CASE WHEN max(bm) OVER () - min(bm) OVER () < 1e-9 THEN 0 ELSE (bm - min(bm) OVER ()) / (max(bm) OVER () - min(bm) OVER ()) END AS norm FROM b),
c AS (SELECT *, CASE WHEN {_INCONSISTENT_A} THEN 0 ELSE (0.40 * norm + 0.30 * len(pos) / 5 + 0.15 * CASE WHEN notice < 30 THEN 1 WHEN notice <= 60 THEN 0.6 WHEN notice <= 90 THEN 0.3 ELSE 0 END + 0.15 * CASE WHEN verified THEN 1 ELSE 0.5 END) * CASE len(neg) WHEN 0 THEN 1 WHEN 1 THEN 0.35 ELSE 0.05 END END AS score FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id) AS rank FROM c)
SELECT candidate_id, rank, round(score, 6)::DOUBLE AS score, current_title || ', ' || printf('%.1f', years) || ' yrs experience' || CASE WHEN len(pos) > 0 THEN '; ' || array_to_string(pos[1:2], ' and ') ELSE '' END ||
  CASE WHEN len(neg) > 0 THEN '. Concern: ' || neg[1] WHEN norm < 0.15 AND len(pos) = 0 THEN '{explain.THIN}' WHEN rank <= 10 THEN '{explain.STRONG}' ELSE '{explain.PARTIAL}' END AS reasoning FROM r WHERE rank <= 100"""

_B_TEXT = "headline || chr(10) || chr(10) || 'Summary: ' || summary || chr(10) || chr(10) || 'Experience:' || chr(10) || array_to_string(list_transform(h, lambda x: x.title || ' at ' || x.company || ': ' || x.description), ' ') || chr(10) || chr(10) || 'Education:' || chr(10) || 'BSc in CS from U' || chr(10) || chr(10) || 'Skills: ' || array_to_string(list_transform(skills, lambda x: x.name), ', ')"
_B_ROLES = "CASE WHEN len(list_filter(h, lambda x: x.now)) > 0 THEN list_filter(h, lambda x: x.now) ELSE h[:1] END"

#: Name: (what makes it of documents, its SQL).
QUERIES = {
    "record_faults_a": (record_faults_a, f"WITH {RECORDS} SELECT d AS doc_id, {_names(FAULTS_A)} AS faults FROM rec"),
    "record_faults_b": (record_faults_b, f"WITH {RECORDS} SELECT d AS doc_id, {_names(FAULTS_B)} AS faults FROM rec"),
    "flattened_a": (flattened_a, f"WITH {FLAT_A} SELECT candidate_id, md5(all_text) AS text_md5, months::BIGINT AS months, array_to_string(employers, '|') AS employers, cur.months::BIGINT AS current_months, len(skills)::BIGINT AS n_skills, len(list_filter(skills, lambda x: x.level = 'expert'))::BIGINT AS n_expert FROM ruled"),
    "flattened_b": (flattened_b, f"WITH {FLAT_B} SELECT candidate_id AS id, md5({_B_TEXT}) AS text_md5, array_to_string(list_transform(skills, lambda x: x.name), '|') AS skills, years AS experience_years, months::BIGINT AS months, {_EMPLOYERS}::BIGINT AS employers, len(list_filter({_B_ROLES}, lambda x: {any_of('lower(x.title)', V.B_RELEVANT_ROLES)} OR {any_of('lower(x.description)', V.B_RELEVANT_ROLES)})) > 0 AS relevant FROM ruled"),
    "rubric_a": (rubric_a, f"WITH {FLAT_A}, m AS (SELECT candidate_id, {_names(POSITIVES_A).replace(chr(39) + ';' + chr(39), chr(39) + ',' + chr(39))} AS positives, {_names(NEGATIVES_A).replace(chr(39) + ';' + chr(39), chr(39) + ',' + chr(39))} AS negatives FROM ruled) SELECT *, CASE WHEN negatives = '' THEN 1 WHEN contains(negatives, ',') THEN 0.05 ELSE 0.35 END::DOUBLE AS multiplier FROM m"),
    "rubric_b": (rubric_b, f"WITH {FLAT_B} SELECT candidate_id AS id, {_names(POSITIVES_B).replace(chr(39) + ';' + chr(39), chr(39) + ',' + chr(39))} AS positives, {_names(NEGATIVES_B).replace(chr(39) + ';' + chr(39), chr(39) + ',' + chr(39))} AS negatives FROM ruled"),
    "first_ranking": (first_ranking, FIRST),
}
