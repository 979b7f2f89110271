"""Rule tables of both rankers: boolean columns with names. All matching is by substring, inside words too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions import vocab as V
from rankloom.functions.text import any_member, contains_any


def _text(x: Column) -> Column:
    return F.lower(F.concat(F.coalesce(x["title"], F.lit("")), F.lit(" "), F.coalesce(x["description"], F.lit(""))))


def negatives_a() -> dict[str, Column]:
    """Of a flat row of the first form."""
    text, history = F.col("all_text_lower"), F.col("career_history")
    by_start = F.array_sort(history, lambda a, b: F.when(a["start_date"] < b["start_date"], -1).when(a["start_date"] > b["start_date"], 1).otherwise(0))
    last = F.try_element_at(by_start, F.lit(-1))
    earlier = F.slice(by_start, 1, F.greatest(F.size(history) - 1, F.lit(0)))
    mean = F.aggregate(history, F.lit(0), lambda a, x: a + x["duration_months"]) / F.size(history)
    validated = (F.col("github_activity_score") > 10) | contains_any(text, V.A_OPEN_SOURCE)
    return {
        "consulting_only": (F.size("employers") > 0) & F.forall("employers", lambda e: contains_any(F.lower(F.btrim(e)), V.A_CONSULTING)),
        "pure_research_only": contains_any(text, V.A_RESEARCH) & ~contains_any(text, V.A_PRODUCTION),
        "recent_ai_only": contains_any(_text(last), V.A_RECENT_AI) & (last["duration_months"] <= 12) & ~F.exists(earlier, lambda x: contains_any(_text(x), V.A_RECENT_AI)),
        "architect_no_recent_code": contains_any(F.lower("current_title"), V.A_LEAD_TITLES) & (F.col("current_role_duration_months") >= 18) & ~contains_any(F.lower("current_role_description"), V.A_CODING),
        "job_hopper": (F.size(history) >= 3) & (mean < 18),
        "cv_speech_robotics_only": contains_any(text, V.A_VISION_SPEECH) & ~contains_any(text, V.A_LANGUAGE),
        "closed_source_no_validation": (F.col("years_of_experience") >= 5) & ~F.coalesce(validated, F.lit(False)),
    }


def positives_a() -> dict[str, Column]:
    text = F.col("all_text_lower")
    return {
        "production_retrieval_experience": contains_any(text, V.A_RETRIEVAL),
        "eval_framework_experience": contains_any(text, V.A_EVALUATION),
        "hr_tech_exposure": contains_any(text, V.A_HIRING) | F.contains(F.lower("current_industry"), F.lit("hr")),
        "open_source_validation": (F.col("github_activity_score") > 30) | contains_any(text, V.A_OPEN_SOURCE),
        "india_or_relocate": (F.lower(F.btrim("country")) == "india") | F.coalesce("willing_to_relocate", F.lit(False)),
    }


def steps(days: Column, scores: tuple[float, float, float]) -> Column:
    """By days of notice: below 30, up to 60, up to 90, more."""
    return F.when(days < 30, F.lit(scores[0])).when(days <= 60, F.lit(scores[1])).when(days <= 90, F.lit(scores[2])).otherwise(F.lit(0.0))


def notice_a(days: Column) -> Column:
    return steps(days, (1.0, 0.6, 0.3))


def multiplier_a(negative: Column) -> Column:
    """For an array of broken rules: 1, 0.35 for one, 0.05 for more."""
    return F.when(F.size(negative) >= 2, 0.05).when(F.size(negative) == 1, 0.35).otherwise(1.0)


class TextOf:
    """What the second ranker's rules read: entries (array of title, company, description) and skills (array of strings)."""

    def __init__(self, entries: Column, skills: Column):
        blank = lambda c: F.coalesce(c, F.lit(""))
        self.each = F.transform(entries, lambda x: F.lower(F.concat_ws(" ", blank(x["title"]), blank(x["company"]), blank(x["description"]))))
        self.titles, self.companies = F.transform(entries, lambda x: F.lower(blank(x["title"]))), F.transform(entries, lambda x: F.lower(blank(x["company"])))
        self.all, self.skills = F.array_join(self.each, " "), F.transform(skills, lambda s: F.lower(F.btrim(s)))

    def anywhere(self, terms: list[str]) -> Column:
        return contains_any(self.all, terms) | any_member(self.skills, terms)

    def said(self, terms: list[str]) -> Column:
        return contains_any(self.all, terms)


def positives_b(t: TextOf, location: Column, willing: Column, notice: Column, url: Column, activity: Column) -> dict[str, Column]:
    places = F.split(F.lower(F.coalesce(location, F.lit(""))), r"[\s,/;]+")
    return {
        "embedding_production": t.anywhere(V.B_EMBEDDING) & t.said(V.B_PRODUCTION),
        "vector_store_production": t.anywhere(V.B_VECTOR_STORE) & t.said(V.B_PRODUCTION),
        "evaluation": t.said(V.B_EVALUATION),
        "place": any_member(places, V.B_PLACES) | F.coalesce(willing, F.lit(False)),
        "short_notice": F.coalesce((notice >= 0) & (notice < 30), F.lit(False)),
        "hiring_domain": t.said(V.B_HIRING),
        "open_work": (url.isNotNull() & F.coalesce(activity > 0, F.lit(False))) | t.said(V.B_OPEN_SOURCE),
    }


def negatives_b(t: TextOf, years: Column, months: Column, employers: Column, activity: Column) -> dict[str, Column]:
    years, activity = F.coalesce(years, F.lit(0.0)), F.coalesce(activity, F.lit(-1))
    return {
        "disqualifier_pure_research": F.exists(t.titles, lambda x: contains_any(x, V.B_ACADEMIC_TITLES)) & ~t.said(V.B_PRODUCTION),
        "disqualifier_recent_ai_only": t.anywhere(V.B_LLM) & ~t.anywhere(V.B_CLASSIC) & (years < 1),
        "disqualifier_lead_no_coding": contains_any(F.get(t.titles, F.lit(0)), V.B_LEAD_TITLES) & ~contains_any(F.get(t.each, F.lit(0)), V.B_CODING),
        "disqualifier_job_hopper": F.coalesce((months != 0) & (employers >= 3) & (months / F.greatest(employers, F.lit(1)) < 18), F.lit(False)),
        "disqualifier_consulting_only": (F.size(t.companies) > 0) & F.forall(t.companies, lambda c: contains_any(c, V.B_CONSULTING)),
        "disqualifier_cv_speech_robotics_only": t.anywhere(V.B_VISION_SPEECH) & ~t.anywhere(V.B_LANGUAGE),
        "disqualifier_closed_source_only": (years >= 5) & activity.isin(-1, 0) & ~t.said(V.B_OPEN_SOURCE),
    }


def count_true(conditions: dict[str, Column]) -> Column:
    total = F.lit(0)
    for c in conditions.values():
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total
