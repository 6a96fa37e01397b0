"""Scalar features of a record, each a column expression over the candidates table.

Lists are taken without null entries; missing values get the default that the definition names. The
projection is split into groups so that each stays small enough to be compiled as one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.config import CITIES, CORE_SKILLS, IT_SERVICES, NICE_SKILLS, PRODUCTION, REF_DATE, ROLE_WORDS, SIZE_ORDINAL, STARTUP_SIZES, STEM, TIER_SCORE
from quillrank.operators.consistency import _count, findings, is_implausible
from quillrank.operators.consistency import plain_date
from quillrank.operators.text import any_contains, career_text, count_contains, either_contains, entries


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("double")


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(value(x), F.lit(0)))


def _ordinal(text: Column, scale: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in scale.items():
        out = F.when(text == k, v).otherwise(out)
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def skill_features() -> dict[str, Column]:
    skills, scores = entries("skills"), F.col("redrob_signals.skill_assessment_scores")
    name = lambda s: F.lower(F.coalesce(s["name"], F.lit("")))
    text = F.col("_career_text")

    def evidenced(s: Column) -> Column:
        return F.coalesce(text.contains(name(s)), F.lit(False)) | (F.coalesce(s["duration_months"], F.lit(0)) > 6) | (F.coalesce(s["endorsements"], F.lit(0)) > 5) | (F.coalesce(F.try_element_at(scores, s["name"]), F.lit(0.0)) > 60) | F.coalesce(s["proficiency"].isin("advanced", "expert"), F.lit(False))

    core = F.filter(skills, lambda s: either_contains(name(s), CORE_SKILLS))
    raw, backed = F.size(core), _count(core, evidenced)
    assessed = F.array_distinct(F.transform(F.filter(core, lambda s: F.try_element_at(scores, s["name"]).isNotNull()), name))
    wanted = F.map_values(F.map_filter(F.coalesce(scores, F.create_map().cast("map<string,double>")), lambda k, v: any_contains(F.lower(k), CORE_SKILLS + NICE_SKILLS)))
    github = F.coalesce(F.col("redrob_signals.github_activity_score"), F.lit(-1.0))
    return {
        "core_skill_count_raw": raw.cast("double"),
        "core_skill_count_evidenced": backed.cast("double"),
        "skill_evidence_ratio": _ratio(backed, raw),
        "nice_skill_count_evidenced": _count(skills, lambda s: either_contains(name(s), NICE_SKILLS) & evidenced(s)).cast("double"),
        "max_assessment_score_jd": F.coalesce(F.array_max(wanted), F.lit(0.0)) / 100,
        "assessment_coverage": F.size(assessed) / float(len(CORE_SKILLS)),
        "github_activity_score": F.when(github >= 0, github / 100).otherwise(0.0),
    }


def yoe_fit(y: Column) -> Column:
    """0 below 2 years, rising to 1 at 6, level to 8, then falling to 0.5 at 12 and 0.2."""
    return F.when(y < 2, 0.0).when(y <= 6, (y - 2) / 4).when(y <= 8, 1.0).when(y <= 12, F.greatest(F.lit(0.5), 1 - (y - 8) / 8)).otherwise(F.greatest(F.lit(0.2), 0.5 - (y - 12) / 20))


def career_features() -> dict[str, Column]:
    jobs = entries("career_history")
    months = lambda j: j["duration_months"]
    service = lambda j: any_contains(F.lower(F.coalesce(j["company"], F.lit(""))), IT_SERVICES)
    yoe = F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0))
    product, total = _sum(F.filter(jobs, lambda j: ~service(j)), months), _sum(jobs, months)
    lasting = F.filter(F.transform(jobs, months), lambda m: m > 0)
    mean = _ratio(F.aggregate(lasting, F.lit(0).cast("bigint"), lambda s, x: s + x), F.size(lasting))
    role = count_contains(F.lower(F.coalesce("profile.current_title", F.lit(""))), ROLE_WORDS)
    return {
        "years_of_experience": yoe,
        "yoe_fit_score": yoe_fit(yoe),
        "product_company_months": product.cast("double"),
        "product_company_ratio": _ratio(product, total),
        "current_role_relevance": F.least(F.lit(1.0), role / 3),
        "ever_at_it_services_only": _flag((F.size(jobs) > 0) & F.forall(jobs, service)),
        "longest_tenure_months": F.coalesce(F.array_max(lasting), F.lit(0)).cast("double"),
        "avg_tenure_months": mean,
        "title_chaser_flag": _flag((F.size(lasting) >= 3) & (mean < 18)),
        "max_company_size": F.coalesce(F.array_max(F.transform(jobs, lambda j: _ordinal(j["company_size"], SIZE_ORDINAL, 0))), F.lit(0)).cast("double"),
        "startup_experience": _flag(F.exists(jobs, lambda j: F.coalesce(j["company_size"].isin(STARTUP_SIZES), F.lit(False)))),
        "production_signal_count": count_contains(F.col("_career_text"), PRODUCTION).cast("double"),
    }


def education_features() -> dict[str, Column]:
    schools = entries("education")
    studied = lambda e: F.lower(F.concat_ws(" ", F.coalesce(e["field_of_study"], F.lit("")), F.coalesce(e["degree"], F.lit(""))))
    return {
        "best_edu_tier": F.coalesce(F.array_max(F.transform(schools, lambda e: _ordinal(e["tier"], TIER_SCORE, 1))), F.lit(1)).cast("double"),
        "stem_degree": _flag(F.exists(schools, lambda e: any_contains(studied(e), STEM))),
    }


def notice_penalty(days: Column) -> Column:
    return F.when(days <= 30, 0.0).when(days >= 180, 1.0).otherwise((days - 30) / 150)


def logistics_features() -> dict[str, Column]:
    at = F.lower(F.concat_ws(" ", F.coalesce("profile.location", F.lit("")), F.coalesce("profile.country", F.lit(""))))
    low, high = (F.coalesce(F.col(f"redrob_signals.expected_salary_range_inr_lpa.{k}"), F.lit(0.0)) for k in ("min", "max"))
    return {
        "india_location": _flag(F.col("profile.country") == "India"),
        "preferred_city_match": _flag(any_contains(at, CITIES)),
        "willing_to_relocate": _flag(F.col("redrob_signals.willing_to_relocate")),
        "notice_penalty": notice_penalty(F.coalesce(F.col("redrob_signals.notice_period_days"), F.lit(90))),
        "salary_in_range": _flag(~((high < 25) | (low > 60))),
        "work_mode_match": F.when(F.lower("redrob_signals.preferred_work_mode").isin("hybrid", "flexible", "onsite"), 1.0).otherwise(0.6),
    }


def behaviour_features() -> dict[str, Column]:
    s = lambda k, d: F.coalesce(F.col(f"redrob_signals.{k}"), F.lit(d))
    active = F.col("redrob_signals.last_active_date")
    days = F.coalesce(F.datediff(F.to_date(F.lit(REF_DATE)), plain_date(active)), F.lit(0))
    recency = F.when(F.coalesce(active, F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), 1 - days / 180))
    response, interviews = s("recruiter_response_rate", 0.0), s("interview_completion_rate", 0.0)
    mixed = F.pow(recency, F.lit(0.5)) * F.pow(response, F.lit(0.3)) * F.pow(interviews, F.lit(0.2)) * F.when(s("open_to_work_flag", False), 1.1).otherwise(0.9)
    return {
        "recency_score": recency,
        "open_to_work": s("open_to_work_flag", False).cast("double"),
        "recruiter_response_rate": response,
        "interview_completion_rate": interviews,
        "applications_30d": F.log1p(s("applications_submitted_30d", 0)),
        "profile_completeness": s("profile_completeness_score", 0.0) / 100,
        "saved_by_recruiters_30d": F.log1p(s("saved_by_recruiters_30d", 0)),
        "verified_contact": s("verified_email", False).cast("double") + s("verified_phone", False).cast("double"),
        "behavioral_composite": F.least(F.lit(1.1), F.greatest(F.lit(0.0), mixed)),
    }


def consistency_features() -> dict[str, Column]:
    return {"consistency_violation_count": F.size("_findings").cast("double"), "is_honeypot": is_implausible(F.col("_findings")).cast("double")}


#: The groups of features that need nothing but the record and the columns ``_career_text`` and ``_findings``.
GROUPS = [skill_features, career_features, education_features, logistics_features, behaviour_features, consistency_features]


def feature_frame(df, keys: list[str]):
    """``keys`` and the features that need nothing but the record."""
    prepared = df.withColumns({"_career_text": career_text(), "_findings": findings()})
    groups = {k: v for group in GROUPS for k, v in group().items()}
    return prepared.select(*keys, *(v.cast("double").alias(k) for k, v in groups.items()))
