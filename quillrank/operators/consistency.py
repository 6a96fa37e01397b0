"""Contradictions inside one record, as arrays of findings computed in the row.

A finding is struct<code, severity>. ``hard`` findings make a record implausible; every one counts. Null lists,
null entries and missing values find nothing. Dates count in the plain form yyyy-mm-dd only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.config import REF_MONTH, REF_YEAR
from quillrank.operators.text import entries

_ISO = r"^\d{4}-\d{2}-\d{2}$"


def plain_date(text: Column) -> Column:
    return F.when(text.rlike(_ISO), F.try_to_date(text, "yyyy-MM-dd"))


def _found(code: str, severity: str, times: Column) -> Column:
    """``times`` findings of one code."""
    one = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    return F.array_repeat(one, F.coalesce(times, F.lit(0)).cast("int"))


def _months(job: Column) -> Column:
    """Whole months from start to end (to the reference month without an end); days of the month do not count."""
    s, e = plain_date(job["start_date"]), plain_date(job["end_date"])
    year = F.when(job["end_date"].isNull(), F.lit(REF_YEAR)).otherwise(F.year(e))
    month = F.when(job["end_date"].isNull(), F.lit(REF_MONTH)).otherwise(F.month(e))
    return (year - F.year(s)) * 12 + month - F.month(s)


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, lambda x: F.coalesce(test(x), F.lit(False))))


def _start_years(jobs: Column) -> Column:
    years = F.transform(jobs, lambda j: F.when(F.substring(j["start_date"], 1, 4).rlike(r"^\d{4}$"), F.substring(j["start_date"], 1, 4).cast("int")))
    return F.filter(years, lambda y: y.isNotNull())


def closed_jobs(jobs: Column) -> Column:
    return F.filter(jobs, lambda j: ~F.coalesce(j["is_current"], F.lit(False)) & (F.coalesce(j["start_date"], F.lit("")) != "") & (F.coalesce(j["end_date"], F.lit("")) != ""))


def overlaps(jobs: Column) -> Column:
    """How many pairs of closed jobs share time; texts are compared as written."""
    closed = closed_jobs(jobs)
    after = F.transform(closed, lambda a, i: _count(F.slice(closed, i + 2, F.greatest(F.size(closed), F.lit(1))), lambda b: (a["start_date"] < b["end_date"]) & (b["start_date"] < a["end_date"])))
    return F.aggregate(after, F.lit(0), lambda s, x: s + x)


def experts(skills: Column) -> Column:
    return _count(skills, lambda s: s["proficiency"] == "expert")


def findings() -> Column:
    """array<struct<code, severity>> of a record with the columns of the candidates table."""
    jobs, skills, schools = entries("career_history"), entries("skills"), entries("education")
    yoe = F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0))
    grad = F.array_max(F.filter(F.transform(schools, lambda e: e["end_year"]), lambda y: y != 0))
    scores = F.col("redrob_signals.skill_assessment_scores")
    first = F.array_min(_start_years(jobs))
    worked = F.aggregate(jobs, F.lit(0), lambda s, j: s + F.coalesce(j["duration_months"], F.lit(0)))
    signup, active = F.coalesce(F.col("redrob_signals.signup_date"), F.lit("")), F.coalesce(F.col("redrob_signals.last_active_date"), F.lit(""))
    return F.concat(
        _found("grad_gap", "soft", (yoe > (REF_YEAR - grad) + 1.5).cast("int")),
        _found("tenure", "hard", _count(jobs, lambda j: (j["duration_months"] != 0) & (j["duration_months"] > _months(j) + 12))),
        _found("expert_zero", "hard", (_count(skills, lambda s: (s["proficiency"] == "expert") & (F.coalesce(s["duration_months"], F.lit(1)) == 0)) >= 1).cast("int")),
        _found("expert_low", "hard", _count(skills, lambda s: (s["proficiency"] == "expert") & (F.try_element_at(scores, s["name"]) < 50))),
        _found("overlap", "soft", overlaps(jobs)),
        _found("yoe_span", "hard", ((yoe > 0) & (yoe > REF_YEAR - first + 2)).cast("int")),
        _found("months_sum", "soft", ((yoe > 0) & (worked > yoe * 12 + 24)).cast("int")),
        _found("many_experts", "soft", (experts(skills) >= 10).cast("int")),
        _found("signup_late", "soft", ((signup != "") & (active != "") & (signup > active)).cast("int")),
    )


def is_implausible(found: Column) -> Column:
    return F.exists(found, lambda x: x["severity"] == "hard")
