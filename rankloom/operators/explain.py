"""Tags, matched and missing points, narratives, and checks of generated explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import flags

# Wording of results.
POSITIVE_PHRASES = {
    "production_retrieval_experience": "hands-on production retrieval/ranking experience",
    "eval_framework_experience": "experience with ranking evaluation (NDCG/MAP-style metrics)",
    "hr_tech_exposure": "prior HR-tech / recruiting-platform exposure",
    "open_source_validation": "externally-validated work (open-source or public activity)",
    "india_or_relocate": "based in India or open to relocation",
}
NEGATIVE_NOTES = {
    "consulting_only": "career has been entirely consulting-firm based",
    "pure_research_only": "background is research-only with no production deployment found",
    "recent_ai_only": "AI/ML exposure looks recent (<=12mo) with no earlier ML background",
    "architect_no_recent_code": "current role reads as architect/lead with no recent hands-on coding signal",
    "job_hopper": "average tenure under 18 months across recent roles",
    "cv_speech_robotics_only": "background is CV/speech/robotics with no NLP/IR signal found",
    "closed_source_no_validation": "5+ yrs experience with no external validation signal found",
}
THIN = ". Thin signal overall -- ranked primarily on absence of red flags, not strong positive match"
STRONG = ". Strong overall alignment with the role"
PARTIAL = ". Reasonable but partial alignment with the role"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def tags(f: dict[str, Column]) -> Column:
    """Threshold tags in their order; a null feature counts as 0. f: the feature columns and inconsistency."""
    v = {k: F.coalesce(c, F.lit(0.0)) for k, c in f.items()}
    engaged = v["behavioral_score"] >= 0.5
    return flags({
        "Strong Seniority Fit": v["seniority_match"] >= 0.9,
        "High Engagement": engaged,
        "Hidden Gem": engaged & (v["bm25_score"] < 0.3) & (v["dense_similarity"] < 0.3),
        "Fast Learner": engaged & (v["trajectory_alignment"] >= 0.3),
        "Career Switcher": (v["trajectory_alignment"] >= 0.4) & (v["skill_overlap"] < 0.1),
        "Skill Gap Risk": v["skill_overlap"] < 0.05,
        "Verified Profile": v["inconsistency"] == 0,
    })


def held(wanted: Column, skills: Column) -> Column:
    """The wanted skills that are among the skills, ASCII case and outer blanks aside."""
    have = F.transform(skills, lambda s: F.lower(F.btrim(s)))
    return F.filter(wanted, lambda w: F.array_contains(have, F.lower(F.btrim(w))))


def lacking(wanted: Column, skills: Column) -> Column:
    have = F.transform(skills, lambda s: F.lower(F.btrim(s)))
    return F.filter(wanted, lambda w: ~F.array_contains(have, F.lower(F.btrim(w))))


def matched_points(must: Column, nice: Column, skills: Column, title: Column) -> Column:
    found = F.transform(held(F.concat(must, nice), skills), lambda s: F.concat(F.lit("Demonstrates matching proficiency in '"), s, F.lit("'.")))
    general = F.when(F.size(must) > 0, F.array(F.concat(F.lit("Matches core qualifications for '"), title, F.lit("'.")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(general)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, rounded from its exact binary value as printf does; exact halves go to the even digit.

    The number is cut in two parts of few bits, whose products with 10 ** digits are exact, so the comparison with a half is too. Numbers
    of 2 ** 20 and more are rounded by their decimal value."""
    x, scale = x.cast("double"), 10.0**digits
    size = F.abs(x)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    whole = F.floor(high * scale)
    over = (high * scale - whole - 0.5) + (size - high) * scale
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    near = F.concat(F.when(x < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", (whole + up.cast("long")) / scale))
    return F.when(size < 1 << 20, near).otherwise(F.format_string(f"%.{digits}f", F.bround(x, digits)))


def share(x: Column) -> Column:
    return F.concat(fixed(F.coalesce(x, F.lit(0.0)) * 100, 1), F.lit("%"))


def narrative(row: dict[str, Column]) -> Column:
    """Six sentences, the last only with tags. row: candidate_id, rank, title, score, overlap, seniority, behaviour, inconsistency, must, nice, skills, tags, location, willing, notice, activity."""
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("None")
    number = lambda x: fixed(F.coalesce(x, F.lit(0.0)), 2)
    return F.concat_ws(" ",
        F.format_string("Candidate %s is ranked #%d for the '%s' role with a composite score of %s.", row["candidate_id"], row["rank"], row["title"], fixed(row["score"], 2)),
        F.concat(F.lit("They show a skill overlap of "), share(row["overlap"]), F.lit(", matching requirements like ["), listed(held(F.concat(row["must"], row["nice"]), row["skills"])), F.lit("] and missing ["), listed(lacking(row["must"], row["skills"])), F.lit("].")),
        F.concat(F.lit("Seniority alignment is rated at "), share(row["seniority"]), F.lit(" based on relevant experience.")),
        F.concat(F.lit("Located in '"), F.coalesce(row["location"], F.lit("Unknown Location")), F.lit("' ("), F.when(row["willing"], "willing to relocate").otherwise("not open to relocation"), F.lit("); "), F.coalesce(F.concat(F.lit("notice period is "), row["notice"].cast("string"), F.lit(" days")), F.lit("notice period unknown")), F.lit(".")),
        F.concat(F.lit("Profile is verified with a behavioral engagement score of "), number(row["behaviour"]), F.lit(" (honeypot risk: "), number(row["inconsistency"]), F.lit(", GitHub score: "), F.coalesce(row["activity"].cast("string"), F.lit("-1")), F.lit(").")),
        F.when(F.size(row["tags"]) > 0, F.concat(F.lit("Key classification tag(s): "), F.array_join(row["tags"], ", "), F.lit("."))),
    )


def confidence(behaviour: Column) -> Column:
    return F.coalesce(F.nullif(behaviour, F.lit(0.0)), F.lit(1.0))


def reasoning_a(title: Column, years: Column, positives: Column, negatives: Column, bm25: Column, rank: Column) -> Column:
    """One line for a ranked row of the first ranker."""
    good = F.transform(F.slice(positives, 1, 2), lambda p: _map(POSITIVE_PHRASES)[p])
    ending = F.when(F.size(negatives) > 0, F.concat(F.lit(". Concern: "), _map(NEGATIVE_NOTES)[F.get(negatives, F.lit(0))])).when((bm25 < 0.15) & (F.size(positives) == 0), THIN).when(rank <= 10, STRONG).otherwise(PARTIAL)
    return F.concat(title, F.lit(", "), fixed(years, 1), F.lit(" yrs experience"), F.when(F.size(good) > 0, F.concat(F.lit("; "), F.array_join(good, " and "))).otherwise(""), ending)


def json_part(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def grounded(points: Column, keywords: Column) -> Column:
    """The points that mention a keyword."""
    return F.filter(points, lambda p: F.exists(keywords, lambda k: F.contains(F.lower(p), F.lower(k))))


def prompt(row: Column) -> Column:
    """What a text provider is asked: the wanted shape of the answer, and the facts as JSON."""
    shape = '{"matched_points": [string], "missing_points": [string], "confidence": number, "narrative": string}'
    return F.concat(F.lit(f"Explain why this candidate matches the role. Use only these facts. Answer with JSON of the shape {shape}\nFacts: "), F.to_json(row))


def accepted(answer: Column, keywords: Column, points: Column, story: Column) -> Column:
    """An answer's points and narrative where they hold; the template's where the answer can't be read or keeps no point."""
    said = F.from_json(json_part(answer), "matched_points array<string>, missing_points array<string>, confidence double, narrative string")
    kept = grounded(said["matched_points"], keywords)
    ok = said["narrative"].isNotNull()
    return F.struct(F.when(ok & (F.coalesce(F.size(kept), F.lit(0)) > 0), kept).otherwise(points).alias("matched_points"), F.when(ok, said["narrative"]).otherwise(story).alias("narrative"), F.when(ok, said["confidence"]).alias("confidence"))
