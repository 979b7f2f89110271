"""Nested records: schema, validation, quarantine, flattening in two forms, consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import vocab as V
from rankloom.functions.text import contains_any, flags

PROFILE = "anonymized_name string, headline string, summary string, location string, country string, years_of_experience double, current_title string, current_company string, current_company_size string, current_industry string"
JOB = "company string, title string, start_date string, end_date string, duration_months int, is_current boolean, industry string, company_size string, description string"
SCHOOL = "institution string, degree string, field_of_study string, start_year int, end_year int, grade string, tier string"
SKILL = "name string, proficiency string, endorsements int, duration_months int"
SIGNALS = "profile_completeness_score double, signup_date string, last_active_date string, open_to_work_flag boolean, profile_views_received_30d int, applications_submitted_30d int, recruiter_response_rate double, avg_response_time_hours double, skill_assessment_scores map<string,double>, connection_count int, endorsements_received int, notice_period_days int, expected_salary_range_inr_lpa struct<min:double,max:double>, preferred_work_mode string, willing_to_relocate boolean, github_activity_score double, search_appearance_30d int, saved_by_recruiters_30d int, interview_completion_rate double, offer_acceptance_rate double, verified_email boolean, verified_phone boolean, linkedin_connected boolean"


def _struct(fields: str) -> str:
    return "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in _fields(fields)) + ">"


def _fields(fields: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def record_schema(signals: str = "signals") -> T.StructType:
    """signals: the name that the records give to their block of activity signals."""
    return T.StructType.fromDDL(f"candidate_id string, profile {_struct(PROFILE)}, career_history array<{_struct(JOB)}>, education array<{_struct(SCHOOL)}>, skills array<{_struct(SKILL)}>, certifications array<struct<name:string,issuer:string,year:int>>, languages array<struct<language:string,proficiency:string>>, {signals} {_struct(SIGNALS)}")


def within(col: Column, low: float, high: float) -> Column:
    """False for null."""
    return F.coalesce(col.between(low, high), F.lit(False))


def one_of(col: Column, values: list[str]) -> Column:
    return F.coalesce(col.isin(values), F.lit(False))


def every(array: Column | str, test) -> Column:
    """True for a null array: a field that may be absent."""
    return F.coalesce(F.forall(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))


def faults_a(signals: str = "signals") -> Column:
    """All broken rules of a record, first form; none if it is valid. Null activity or acceptance is a fault, not an error."""
    s, h = F.col(signals), F.col("career_history")
    n = F.coalesce(F.size(h), F.lit(0))
    absent = lambda c, top: F.coalesce((c == -1) | c.between(0, top), F.lit(False))
    return flags({
        "candidate_id": ~F.coalesce(F.col("candidate_id").rlike("^CAND_[0-9]{7}$"), F.lit(False)),
        "profile": F.col("profile").isNull(),
        "profile.current_company_size": ~one_of(F.col("profile.current_company_size"), V.COMPANY_SIZES),
        "profile.years_of_experience": ~within(F.col("profile.years_of_experience"), 0, 50),
        "career_history": ~n.between(1, 10),
        "career_history.company_size": ~every(h, lambda x: x["company_size"].isin(V.COMPANY_SIZES)),
        "career_history.duration_months": ~every(h, lambda x: x["duration_months"] >= 0),
        "education.tier": ~every("education", lambda x: x["tier"].isin(V.EDUCATION_TIERS)),
        "skills.proficiency": ~every("skills", lambda x: x["proficiency"].isin(V.PROFICIENCIES)),
        signals: s.isNull(),
        f"{signals}.preferred_work_mode": ~one_of(s["preferred_work_mode"], V.WORK_MODES),
        f"{signals}.github_activity_score": ~absent(s["github_activity_score"], 100),
        f"{signals}.offer_acceptance_rate": ~absent(s["offer_acceptance_rate"], 1),
        f"{signals}.notice_period_days": ~within(s["notice_period_days"], 0, 180),
    })


def faults_b(signals: str = "signals") -> Column:
    """All broken rules of a record, second form: every field but the optional ones must be there and in its range."""
    s, p = F.col(signals), F.col("profile")
    named = {"candidate_id": ~F.coalesce(F.col("candidate_id").rlike("^CAND_[0-9]{7}$"), F.lit(False)), "profile": p.isNull(), signals: s.isNull(), "skills": F.col("skills").isNull()}
    named |= {f"profile.{f.split()[0]}": p[f.split()[0]].isNull() for f in map(str.strip, _fields(PROFILE))}
    named |= {f"{signals}.{f.split()[0]}": s[f.split()[0]].isNull() for f in map(str.strip, _fields(SIGNALS))}
    n = F.coalesce(F.size("career_history"), F.lit(0))
    full = lambda x, names: [x[k].isNotNull() for k in names.split()]

    def conj(parts):
        out = parts[0]
        for q in parts[1:]:
            out = out & q
        return out

    ranges = {"profile.years_of_experience": (0, 50)} | {f"{signals}.{k}": v for k, v in {"profile_completeness_score": (0, 100), "recruiter_response_rate": (0, 1), "avg_response_time_hours": (0, float("inf")), "notice_period_days": (0, 180), "github_activity_score": (-1, 100), "interview_completion_rate": (0, 1), "offer_acceptance_rate": (-1, 1)}.items()}
    named |= {k + ".range": ~within(F.col(k), *v) for k, v in ranges.items()}
    named |= {
        "profile.current_company_size.value": ~one_of(p["current_company_size"], V.COMPANY_SIZES),
        f"{signals}.preferred_work_mode.value": ~one_of(s["preferred_work_mode"], V.WORK_MODES),
        "career_history": ~n.between(1, 10) | ~every("career_history", lambda x: conj(full(x, "company title start_date duration_months is_current industry description")) & (x["duration_months"] >= 0) & x["company_size"].isin(V.COMPANY_SIZES)),
        "education": (F.size("education") > 5) | ~every("education", lambda x: conj(full(x, "institution degree field_of_study")) & x["start_year"].between(1970, 2030) & x["end_year"].between(1970, 2035) & x["tier"].isin(V.EDUCATION_TIERS)),
        "skills.item": ~every("skills", lambda x: x["name"].isNotNull() & x["proficiency"].isin(V.PROFICIENCIES) & (x["endorsements"] >= 0) & (F.coalesce(x["duration_months"], F.lit(0)) >= 0)),
        "languages": ~every("languages", lambda x: x["proficiency"].isin(V.LANGUAGE_LEVELS)),
    }
    return flags(named)


def split_valid(rows: DataFrame, faults: Column, source: str, kind: str, record_id: str, row_index: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantine rows). The quarantine keeps the whole row as JSON and all reasons."""
    checked = rows.withColumn("_faults", faults)
    bad = checked.filter(F.size("_faults") > 0)
    payload = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    rejected = bad.select(F.lit(source).alias("source"), F.col(row_index).cast("int").alias("row_index"), F.lit(kind).alias("record_type"), F.col(record_id).cast("string").alias("record_id"), F.array_join("_faults", "; ").alias("reason"), payload.alias("payload"))
    return checked.filter(F.size("_faults") == 0).drop("_faults"), rejected


def first_seen(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each key, the others)."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").drop("_n")


def flatten_a(records: DataFrame, signals: str = "signals") -> DataFrame:
    """One flat row of features for each record, first form: employers with repeats, the current role or else the last."""
    s, h = F.col(signals), F.col("career_history")
    current = F.coalesce(F.get(F.filter(h, lambda x: x["is_current"]), F.lit(0)), F.try_element_at(h, F.lit(-1)))
    blank = lambda c: F.coalesce(c, F.lit(""))
    words = F.concat(F.array(blank(F.col("profile.headline")), blank(F.col("profile.summary"))), F.flatten(F.transform(h, lambda x: F.array(blank(x["title"]), blank(x["description"])))))
    text = F.array_join(words, " ")
    from_profile = [F.col(f"profile.{c}").alias(c) for c in ("current_title", "current_company", "current_industry", "years_of_experience", "location", "country")]
    from_signals = [s[c].alias(c) for c in ("notice_period_days", "willing_to_relocate", "preferred_work_mode", "recruiter_response_rate", "interview_completion_rate", "github_activity_score", "offer_acceptance_rate", "open_to_work_flag", "last_active_date", "verified_email", "verified_phone", "linkedin_connected", "profile_completeness_score", "endorsements_received")]
    return records.select(
        "candidate_id", *from_profile,
        F.aggregate(h, F.lit(0), lambda a, x: a + x["duration_months"]).alias("total_career_months"),
        F.size(h).alias("num_employers"), F.transform(h, lambda x: F.btrim(x["company"])).alias("employers"),
        current["duration_months"].alias("current_role_duration_months"), blank(current["description"]).alias("current_role_description"),
        text.alias("all_text"), F.lower(text).alias("all_text_lower"),
        F.greatest(F.size("skills"), F.lit(0)).alias("num_skills"), F.greatest(F.size(F.filter("skills", lambda x: x["proficiency"] == "expert")), F.lit(0)).alias("num_expert_skills"),
        *from_signals, "career_history", "skills", "education", signals,
    )


def flatten_b(records: DataFrame, signals: str = "signals") -> DataFrame:
    """One canonical row for each record, second form: a text of sections, distinct employers, nested parts as JSON."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    h = F.coalesce("career_history", F.array().cast(records.schema["career_history"].dataType))
    jobs = F.array_join(F.transform(h, lambda x: F.concat(blank(x["title"]), F.lit(" at "), blank(x["company"]), F.lit(": "), blank(x["description"]))), " ")
    schools = F.array_join(F.transform("education", lambda x: F.concat(blank(x["degree"]), F.lit(" in "), blank(x["field_of_study"]), F.lit(" from "), blank(x["institution"]))), " ")
    names = F.transform("skills", lambda x: blank(x["name"]))
    text = F.concat(blank(F.col("profile.headline")), F.lit("\n\nSummary: "), blank(F.col("profile.summary")), F.lit("\n\nExperience:\n"), jobs, F.lit("\n\nEducation:\n"), blank(schools), F.lit("\n\nSkills: "), blank(F.array_join(names, ", ")))
    now = F.filter(h, lambda x: F.coalesce(x["is_current"], F.lit(False)))
    roles = F.when(F.size(now) > 0, now).otherwise(F.slice(h, 1, 1))
    relevant = F.exists(roles, lambda x: contains_any(F.lower(blank(x["title"])), V.B_RELEVANT_ROLES) | contains_any(F.lower(blank(x["description"])), V.B_RELEVANT_ROLES))
    return records.select(
        F.col("candidate_id").alias("id"), text.alias("raw_resume_text"), F.filter(names, lambda x: x != "").alias("skills_raw"),
        F.coalesce("profile.years_of_experience", F.lit(0.0)).alias("experience_years"), F.to_json("education").alias("education"), F.col("profile.location").alias("location"),
        F.lit(None).cast("string").alias("github_url"), F.to_json(signals).alias("activity_metadata"),
        F.aggregate(h, F.lit(0), lambda a, x: a + F.coalesce(x["duration_months"], F.lit(0))).alias("total_career_months"),
        F.size(F.array_distinct(F.transform(F.filter(h, lambda x: blank(x["company"]) != ""), lambda x: F.lower(F.btrim(x["company"]))))).alias("num_employers"),
        relevant.alias("current_role_ai_relevant"), F.to_json("profile").alias("profile"), F.to_json(h).alias("career_history"), F.to_json("skills").alias("skills"), F.to_json(signals).alias("signals"),
    )


def inconsistencies_a() -> Column:
    """Flags of a flat row, first form: expert skills of at most one month (null counts as 0), history over stated years by more than 3."""
    thin = F.filter("skills", lambda x: (x["proficiency"] == "expert") & (F.coalesce(x["duration_months"], F.lit(0)) <= 1))
    expert = F.transform(thin, lambda x: F.concat(F.lit("expert_zero_duration:"), x["name"]))
    years = F.flatten(F.array(flags({"experience_mismatch": F.col("total_career_months") / 12 > F.col("years_of_experience") + 3})))
    return F.concat(F.coalesce(expert, F.array().cast("array<string>")), years)


def inconsistencies_b(skills: Column, history: Column, years: Column) -> Column:
    """Flags, second form: expert skills of exactly 0 months, and stated years that differ from the history either way."""
    thin = F.filter(skills, lambda x: (F.lower(F.btrim(x["proficiency"])) == "expert") & (x["duration_months"] == 0))
    expert = F.transform(thin, lambda x: F.concat(F.lit("expert_skill_zero_duration:"), x["name"]))
    had = F.coalesce(F.aggregate(history, F.lit(0), lambda a, x: a + F.coalesce(x["duration_months"], F.lit(0))), F.lit(0)) / 12
    empty = F.coalesce(F.size(history), F.lit(0)) <= 0
    off = (years > 0) & (empty | (had == 0) | (F.abs(years - had) > F.greatest(F.lit(3.0), 0.5 * years)))
    return F.concat(F.coalesce(expert, F.array().cast("array<string>")), flags({"inconsistent_experience_years": off}))
