"""Activity features: recency, frequency, velocity, breadth, availability, engagement, trust; population scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.rules import steps

AS_OF, HALF_LIFE = "2026-06-17", 90.0
METRICS = ("contribution_frequency", "recency_score", "learning_velocity", "open_source_breadth", "availability_score", "engagement_score", "trust_score")
TIMELINE, SNAPSHOTS = "array<struct<date:string,count:double,repo:string>>", "array<struct<date:string,skills:array<string>>>"


def day(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def recency(last: Column, as_of: str | Column = AS_OF, half_life: float = HALF_LIFE) -> Column:
    """Halves every half_life days; 0.5 for a missing or unreadable date; days in the future count as none."""
    as_of = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    days = F.greatest(F.datediff(as_of, last), F.lit(0))
    return F.when(last.isNull(), 0.5).otherwise(F.exp(-F.log(F.lit(2.0)) / half_life * days))


def frequency(timeline: Column) -> Column:
    """Sum of counts, 1 where an event has none."""
    return F.coalesce(F.aggregate(timeline, F.lit(0.0), lambda a, x: a + F.coalesce(x["count"], F.lit(1.0))), F.lit(0.0))


def velocity(snapshots: Column) -> Column:
    """Skills added since the first dated snapshot, a year; of fewer than two snapshots 0; over a tenth of a year or less, the number itself."""
    dated = F.array_sort(F.filter(F.transform(snapshots, lambda x: F.struct(day(x["date"]).alias("d"), x["skills"].alias("s"))), lambda x: x["d"].isNotNull()))
    seen = F.array_distinct(F.flatten(F.transform(dated, lambda x: x["s"])))
    added = F.size(F.array_except(seen, F.get(dated, F.lit(0))["s"])).cast("double")
    years = F.datediff(F.try_element_at(dated, F.lit(-1))["d"], F.get(dated, F.lit(0))["d"]) / 365.25
    return F.when(F.coalesce(F.size(dated), F.lit(0)) < 2, 0.0).when(years <= 0.1, added).otherwise(added / years)


def breadth(url: Column, timeline: Column) -> Column:
    repos = F.size(F.array_distinct(F.filter(F.transform(timeline, lambda x: x["repo"]), lambda r: F.coalesce(r != "", F.lit(False)))))
    return F.least(F.lit(1.0), 0.4 * (F.coalesce(url, F.lit("")) != "").cast("int") + 0.1 * F.greatest(F.coalesce(repos, F.lit(0)), F.lit(0)))


def or_half(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.5))


def availability(recent: Column, open_to_work: Column, notice: Column) -> Column:
    return 0.4 * recent + 0.4 * or_half(open_to_work.cast("int").cast("double")) + 0.2 * F.when(notice.isNull(), 0.5).otherwise(steps(notice, (1.0, 0.5, 0.2)))


def engagement(response: Column, hours: Column, completion: Column) -> Column:
    return 0.4 * or_half(response) + 0.3 * or_half(1 / (1 + hours / 24)) + 0.3 * or_half(completion)


def trust(email: Column, phone: Column, linked: Column, endorsements: Column, skills: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rate = F.least(F.lit(1.0), endorsements / F.greatest(skills, F.lit(1)) / 5)
    return 0.2 * yes(email) + 0.2 * yes(phone) + 0.2 * yes(linked) + 0.4 * F.when(endorsements.isNull(), 0.5).otherwise(rate)


def confidence(has_signals: Column, *parts: Column) -> Column:
    """0.3 without any signal; else 1, less 0.2 for each missing part, but at least 0.4."""
    absent = reduce(lambda a, b: a + b, [p.isNull().cast("int") for p in parts])
    return F.when(~has_signals, 0.3).otherwise(F.greatest(F.lit(0.4), 1.0 - 0.2 * absent))


def scrubbed(col: Column) -> Column:
    """-1 means no data."""
    return F.nullif(col, F.lit(-1).cast("double"))


def profiles(rows: DataFrame, signals: str, key: str = "id", url: str = "github_url", as_of: str = AS_OF) -> DataFrame:
    """key, the seven metrics (not scaled) and signal_confidence. `signals` is a struct column with the activity fields; fields it lacks count as missing."""
    names = {f.name: f.dataType for f in rows.schema[signals].dataType}
    field = lambda n, t: F.col(f"{signals}.{n}").cast(t) if n in names else F.lit(None).cast(t)
    number = lambda n: scrubbed(field(n, "double"))
    timeline, snapshots = field("timeline", TIMELINE), field("skills_over_time", SNAPSHOTS)
    last = F.coalesce(F.nullif(field("last_active_date", "string"), F.lit("")), field("last_activity_date", "string"))
    link = F.col(url) if url in rows.columns else F.lit(None).cast("string")
    has = F.col(signals).isNotNull() | (F.coalesce(link, F.lit("")) != "")
    recent = recency(day(last), as_of)
    made = {
        "contribution_frequency": frequency(timeline), "recency_score": recent, "learning_velocity": velocity(snapshots), "open_source_breadth": breadth(link, timeline),
        "availability_score": availability(recent, field("open_to_work_flag", "boolean"), number("notice_period_days")),
        "engagement_score": engagement(number("recruiter_response_rate"), number("avg_response_time_hours"), number("interview_completion_rate")),
        "trust_score": trust(field("verified_email", "boolean"), field("verified_phone", "boolean"), field("linkedin_connected", "boolean"), number("endorsements_received"), F.coalesce(F.size("skills"), F.lit(0)) if "skills" in rows.columns else F.lit(0)),
    }
    empty_to_none = lambda c: F.when(F.size(c) > 0, c)
    return rows.select(key, *[F.when(has, c).otherwise(0.0).alias(n) for n, c in made.items()], confidence(has, last, empty_to_none(timeline), empty_to_none(snapshots)).alias("signal_confidence"))


def population_scaled(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Each metric scaled to 0..1 over all rows; a constant one to 0.5. One global aggregate of a row, joined back."""
    ends = rows.agg(*[f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda m: F.when(F.col(f"_hi_{m}") - F.col(f"_lo_{m}") > 0, (F.col(m) - F.col(f"_lo_{m}")) / (F.col(f"_hi_{m}") - F.col(f"_lo_{m}"))).otherwise(0.5)
    return rows.crossJoin(F.broadcast(ends)).select(*[scaled(c).alias(c) if c in metrics else F.col(c) for c in rows.columns])
