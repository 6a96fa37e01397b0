"""Queries over nested records: text units, contradictions, scalar features, latest delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions import config as C
from quillrank.functions.tables import table
from quillrank.operators import consistency, features
from quillrank.operators.text import career_text, chunks, index_text


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates")


def record_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("record_id", F.posexplode(chunks()).alias("chunk_pos", "text")).select("record_id", "chunk_pos", F.md5("text").alias("text_md5"))


def record_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("record_id", F.md5(index_text()).alias("text_md5"), F.length(index_text()).alias("n_chars"))


def latest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each candidate; only keys and times meet in the aggregate."""
    last = F.max(F.struct("received_at", "record_id")).alias("_m")
    return _candidates(spark, sf_dir).where("candidate_id is not null").groupBy("candidate_id").agg(last, F.count(F.lit(1)).alias("n_deliveries")).select("candidate_id", F.col("_m.record_id").alias("record_id"), "n_deliveries")


def record_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir).select("record_id", F.explode(consistency.findings()).alias("f"))
    return found.groupBy("record_id", "f.code", "f.severity").agg(F.count(F.lit(1)).alias("n"))


def record_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir).select("record_id", consistency.findings().alias("_f"))
    return found.select("record_id", consistency.is_implausible(F.col("_f")).cast("int").alias("is_implausible"), F.size("_f").alias("n_findings"), F.array_join(F.array_sort(F.array_distinct(F.col("_f.code"))), ",").alias("codes"))


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of each code implausible records have."""
    found = _candidates(spark, sf_dir).select(consistency.findings().alias("_f")).where(consistency.is_implausible(F.col("_f")))
    return found.select(F.explode("_f").alias("f")).groupBy("f.code").agg(F.count(F.lit(1)).alias("n"))


def implausible_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir).select(consistency.is_implausible(consistency.findings()).cast("int").alias("x"))
    return found.agg(F.count(F.lit(1)).alias("n_records"), F.sum("x").alias("n_implausible"), F.round(F.avg("x") * 100, 4).alias("percent"))


def audit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a record's audit and its bucket: doubtful from 2 points, noted from 1, else clean."""
    c = _candidates(spark, sf_dir)
    skills = consistency.entries("skills")
    late = (F.coalesce("redrob_signals.signup_date", F.lit("")) != "") & (F.coalesce("redrob_signals.last_active_date", F.lit("")) != "") & (F.col("redrob_signals.signup_date") > F.col("redrob_signals.last_active_date"))
    n = consistency.experts(skills)
    idle = F.datediff(F.to_date(F.lit(C.REF_DATE)), consistency.plain_date(F.col("redrob_signals.last_active_date"))) > 180
    zero = F.exists(skills, lambda s: F.coalesce((s["proficiency"] == "expert") & (s["duration_months"] == 0), F.lit(False)))
    points = F.when(late, 2).otherwise(0) + F.when(n >= 12, 2).when(n >= 10, 1).otherwise(0) + F.when(F.coalesce(F.col("redrob_signals.recruiter_response_rate"), F.lit(1.0)) < 0.15, 1).otherwise(0) + F.when(idle, 1).otherwise(0) + F.when(zero, 3).otherwise(0)
    scored = c.select("record_id", points.alias("points"))
    return scored.select("record_id", "points", F.when(F.col("points") >= 2, "doubtful").when(F.col("points") == 1, "noted").otherwise("clean").alias("bucket"))


def _features(group):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared = _candidates(spark, sf_dir).withColumn("_career_text", career_text())
        return prepared.select("record_id", *(F.round(v.cast("double"), 6).alias(k) for k, v in group().items()))

    return query


skill_features = _features(features.skill_features)
career_features = _features(features.career_features)
education_features = _features(features.education_features)
logistics_features = _features(features.logistics_features)
behaviour_features = _features(features.behaviour_features)


def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, mean, greatest value and share of non-zero values of every record feature, as rows."""
    frame = features.feature_frame(_candidates(spark, sf_dir), ["record_id"])
    names = [c for c in frame.columns if c != "record_id"]
    long = frame.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.round(n, 6))))).alias("feature", "v"))
    return long.groupBy("feature").agg(F.round(F.min("v"), 6).alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"), F.round(F.avg((F.col("v") != 0).cast("int")), 6).alias("nonzero"))


def latest_skill_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessed scores by claimed proficiency: count, mean, extremes and index percentiles, over exact counts per score."""
    skills = _candidates(spark, sf_dir).select(F.col("redrob_signals.skill_assessment_scores").alias("m"), F.explode(consistency.entries("skills")).alias("s"))
    scored = skills.select(F.col("s.proficiency").alias("proficiency"), F.try_element_at("m", F.col("s.name")).alias("v")).where("v is not null and proficiency is not null")
    counts = scored.groupBy("proficiency", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("proficiency").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(W.partitionBy("proficiency")))
    at = [F.min(F.when(F.col("_upto") > F.floor(F.col("_all").cast("double") * p), F.col("v"))).alias(f"p{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)]
    return ranked.groupBy("proficiency").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 4).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), *at)


def expert_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each threshold: records whose worst expert skill is below it, and those of them with another hard finding."""
    c = _candidates(spark, sf_dir)
    scores = F.col("redrob_signals.skill_assessment_scores")
    worst = F.array_min(F.transform(F.filter(consistency.entries("skills"), lambda s: s["proficiency"] == "expert"), lambda s: F.try_element_at(scores, s["name"])))
    other = F.exists(consistency.findings(), lambda x: (x["severity"] == "hard") & (x["code"] != "expert_low"))
    rows = c.select(worst.alias("w"), other.alias("o")).where("w is not null").select(F.explode(F.array(*map(F.lit, C.SWEEP))).alias("threshold"), "w", "o")
    below = F.col("w") < F.col("threshold")
    return rows.groupBy("threshold").agg(F.sum(below.cast("int")).alias("n_below"), F.sum((below & F.col("o")).cast("int")).alias("n_both"))


_JOBS = "jobs AS (SELECT record_id, pos, j FROM (SELECT record_id, unnest(career_history) AS j, generate_subscripts(career_history, 1) AS pos FROM candidates) WHERE j IS NOT NULL)"
_SKILLS = "skills AS (SELECT record_id, s, m FROM (SELECT record_id, unnest(skills) AS s, redrob_signals.skill_assessment_scores AS m FROM candidates) WHERE s IS NOT NULL)"
_SCHOOLS = "schools AS (SELECT record_id, e FROM (SELECT record_id, unnest(education) AS e FROM candidates) WHERE e IS NOT NULL)"
_CTEXT = "texts AS (SELECT c.record_id, lower(concat_ws(' ', profile.summary, profile.headline, (SELECT string_agg(j.description, ' ' ORDER BY pos) FROM jobs WHERE jobs.record_id = c.record_id))) AS t FROM candidates AS c)"


def _dated(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST({x} AS DATE) END)"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _many(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


def _either(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}') OR contains('{w}', {text})" for w in words) + ")"


def _case(x: str, scale: dict, default: int) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scale.items()) + f" ELSE {default} END)"


#: The text units of a record, over a table ``jobs``.
CHUNKS_EVERY = """
WITH parts AS (
  SELECT record_id, pos AS o, coalesce(j.title, '') || ' at ' || coalesce(j.company, '') || ': ' || j.description AS t FROM jobs WHERE coalesce(j.description, '') <> ''
  UNION ALL SELECT record_id, 1000000, profile.summary FROM candidates WHERE coalesce(profile.summary, '') <> ''
  UNION ALL SELECT record_id, 1000001, profile.headline FROM candidates WHERE coalesce(profile.headline, '') <> '')
SELECT * FROM parts UNION ALL SELECT record_id, 0, coalesce(profile.current_title, '') FROM candidates WHERE record_id NOT IN (SELECT record_id FROM parts)
"""
CHUNKS_SQL = f"""
WITH {_JOBS}, every AS ({CHUNKS_EVERY})
SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY o) - 1 AS INT) AS chunk_pos, md5(t) AS text_md5 FROM every
"""

LATEST_SQL = """
SELECT candidate_id, arg_max(record_id, (received_at, record_id)) AS record_id, count(*) AS n_deliveries
FROM candidates WHERE candidate_id IS NOT NULL AND received_at IS NOT NULL GROUP BY 1
"""

_FINDINGS = f"""
WITH {_JOBS}, {_SKILLS}, {_SCHOOLS},
base AS (SELECT record_id, coalesce(profile.years_of_experience, 0) AS yoe, coalesce(redrob_signals.signup_date, '') AS su, coalesce(redrob_signals.last_active_date, '') AS la FROM candidates),
spans AS (
  SELECT record_id, pos, j.duration_months AS dm, {_dated('j.start_date')} AS s, j.end_date IS NULL AS open, {_dated('j.end_date')} AS e FROM jobs),
closed AS (SELECT record_id, pos, j.start_date AS s, j.end_date AS e FROM jobs WHERE NOT coalesce(j.is_current, false) AND coalesce(j.start_date, '') <> '' AND coalesce(j.end_date, '') <> ''),
per_job AS (
  SELECT record_id, sum(coalesce(j.duration_months, 0)) AS worked, min(CASE WHEN regexp_matches(substr(j.start_date, 1, 4), '^\\d{{4}}$') THEN CAST(substr(j.start_date, 1, 4) AS INT) END) AS first FROM jobs GROUP BY 1),
found AS (
  SELECT record_id, 'grad_gap' AS code, 'soft' AS severity, 1 AS n FROM base JOIN (SELECT record_id, max(e.end_year) AS g FROM schools WHERE e.end_year <> 0 GROUP BY 1) USING (record_id) WHERE yoe > (2026 - g) + 1.5
  UNION ALL
  SELECT record_id, 'tenure', 'hard', count(*) FROM spans
  WHERE dm <> 0 AND dm > ((CASE WHEN open THEN 2026 ELSE year(e) END) - year(s)) * 12 + (CASE WHEN open THEN 6 ELSE month(e) END) - month(s) + 12 GROUP BY 1
  UNION ALL
  SELECT DISTINCT record_id, 'expert_zero', 'hard', 1 FROM skills WHERE s.proficiency = 'expert' AND s.duration_months = 0
  UNION ALL
  SELECT record_id, 'expert_low', 'hard', count(*) FROM skills WHERE s.proficiency = 'expert' AND m[s.name] < 50 GROUP BY 1
  UNION ALL
  SELECT a.record_id, 'overlap', 'soft', count(*) FROM closed AS a JOIN closed AS b ON a.record_id = b.record_id AND a.pos < b.pos AND a.s < b.e AND b.s < a.e GROUP BY 1
  UNION ALL
  SELECT record_id, 'yoe_span', 'hard', 1 FROM base JOIN per_job USING (record_id) WHERE yoe > 0 AND yoe > 2026 - first + 2
  UNION ALL
  SELECT record_id, 'months_sum', 'soft', 1 FROM base JOIN per_job USING (record_id) WHERE yoe > 0 AND worked > yoe * 12 + 24
  UNION ALL
  SELECT record_id, 'many_experts', 'soft', 1 FROM skills WHERE s.proficiency = 'expert' GROUP BY 1 HAVING count(*) >= 10
  UNION ALL
  SELECT record_id, 'signup_late', 'soft', 1 FROM base WHERE su <> '' AND la <> '' AND su > la)
"""
FINDINGS_SQL = _FINDINGS + "SELECT record_id, code, severity, CAST(n AS BIGINT) AS n FROM found"
ROLLUP_SQL = _FINDINGS + """
SELECT record_id, CAST(coalesce(max(CAST(severity = 'hard' AS INT)), 0) AS INT) AS is_implausible, CAST(coalesce(sum(n), 0) AS INT) AS n_findings, coalesce(string_agg(code, ',' ORDER BY code), '') AS codes
FROM candidates LEFT JOIN found USING (record_id) GROUP BY 1
"""
FINDING_COUNTS_SQL = _FINDINGS + "SELECT code, CAST(sum(n) AS BIGINT) AS n FROM found WHERE record_id IN (SELECT record_id FROM found WHERE severity = 'hard') GROUP BY 1"
IMPLAUSIBLE_SQL = _FINDINGS + """
SELECT count(*) AS n_records, CAST(sum(x) AS BIGINT) AS n_implausible, round(avg(x) * 100, 4) AS percent
FROM (SELECT CAST(record_id IN (SELECT record_id FROM found WHERE severity = 'hard') AS INT) AS x FROM candidates)
"""
SWEEP_SQL = _FINDINGS + f""",
worst AS (SELECT record_id, min(m[s.name]) AS w FROM skills WHERE s.proficiency = 'expert' GROUP BY 1),
flagged AS (SELECT w, record_id IN (SELECT record_id FROM found WHERE severity = 'hard' AND code <> 'expert_low') AS o FROM worst WHERE w IS NOT NULL)
SELECT CAST(threshold AS INT) AS threshold, CAST(sum(CAST(w < threshold AS INT)) AS BIGINT) AS n_below, CAST(sum(CAST(w < threshold AND o AS INT)) AS BIGINT) AS n_both
FROM flagged, (SELECT unnest({C.SWEEP}) AS threshold) GROUP BY 1
"""
AUDIT_SQL = f"""
WITH {_SKILLS},
ex AS (SELECT record_id, count(*) AS n, max(CAST(s.duration_months = 0 AS INT)) AS z FROM skills WHERE s.proficiency = 'expert' GROUP BY 1),
p AS (
  SELECT c.record_id,
    (CASE WHEN coalesce(redrob_signals.signup_date, '') <> '' AND coalesce(redrob_signals.last_active_date, '') <> '' AND redrob_signals.signup_date > redrob_signals.last_active_date THEN 2 ELSE 0 END)
    + (CASE WHEN ex.n >= 12 THEN 2 WHEN ex.n >= 10 THEN 1 ELSE 0 END)
    + (CASE WHEN coalesce(redrob_signals.recruiter_response_rate, 1) < 0.15 THEN 1 ELSE 0 END)
    + (CASE WHEN DATE '{C.REF_DATE}' - {_dated('redrob_signals.last_active_date')} > 180 THEN 1 ELSE 0 END)
    + (CASE WHEN ex.z = 1 THEN 3 ELSE 0 END) AS points
  FROM candidates AS c LEFT JOIN ex ON ex.record_id = c.record_id)
SELECT record_id, points, CASE WHEN points >= 2 THEN 'doubtful' WHEN points = 1 THEN 'noted' ELSE 'clean' END AS bucket FROM p
"""
SKILL_SQL = f"""
WITH {_JOBS}, {_SKILLS}, {_CTEXT},
named AS (SELECT record_id, lower(coalesce(s.name, '')) AS n, s, m[s.name] AS v FROM skills),
judged AS (
  SELECT record_id, n, v, {_either('n', C.CORE_SKILLS)} AS core, {_either('n', C.NICE_SKILLS)} AS nice,
    contains(t, n) OR coalesce(s.duration_months, 0) > 6 OR coalesce(s.endorsements, 0) > 5 OR coalesce(v, 0) > 60 OR coalesce(s.proficiency IN ('advanced', 'expert'), false) AS backed
  FROM named JOIN texts USING (record_id)),
agg AS (
  SELECT record_id, count(*) FILTER (core) AS raw, count(*) FILTER (core AND backed) AS ev, count(*) FILTER (nice AND backed) AS nice, count(DISTINCT n) FILTER (core AND v IS NOT NULL) AS cov FROM judged GROUP BY 1),
wanted AS (
  SELECT record_id, max(v) AS best FROM (SELECT record_id, unnest(map_keys(redrob_signals.skill_assessment_scores)) AS k, unnest(map_values(redrob_signals.skill_assessment_scores)) AS v FROM candidates)
  WHERE {_any('lower(k)', C.CORE_SKILLS + C.NICE_SKILLS)} GROUP BY 1)
SELECT c.record_id, CAST(coalesce(raw, 0) AS DOUBLE) AS core_skill_count_raw, CAST(coalesce(ev, 0) AS DOUBLE) AS core_skill_count_evidenced,
  round(CASE WHEN raw > 0 THEN ev / raw ELSE 0 END, 6) AS skill_evidence_ratio, CAST(coalesce(nice, 0) AS DOUBLE) AS nice_skill_count_evidenced,
  round(coalesce(best, 0) / 100, 6) AS max_assessment_score_jd, round(coalesce(cov, 0) / 23, 6) AS assessment_coverage,
  round(CASE WHEN redrob_signals.github_activity_score >= 0 THEN redrob_signals.github_activity_score / 100 ELSE 0 END, 6) AS github_activity_score
FROM candidates AS c LEFT JOIN agg ON agg.record_id = c.record_id LEFT JOIN wanted ON wanted.record_id = c.record_id
"""
CAREER_SQL = f"""
WITH {_JOBS}, {_CTEXT},
f AS (
  SELECT record_id, {_any("lower(coalesce(j.company, ''))", C.IT_SERVICES)} AS it, coalesce(j.duration_months, 0) AS dm, {_case('j.company_size', C.SIZE_ORDINAL, 0)} AS size, coalesce(j.company_size IN ('1-10', '11-50', '51-200'), false) AS startup FROM jobs),
a AS (
  SELECT record_id, sum(dm) FILTER (NOT it) AS product, sum(dm) AS total, bool_and(it) AS only_it, max(dm) FILTER (dm > 0) AS longest, avg(dm) FILTER (dm > 0) AS mean, count(*) FILTER (dm > 0) AS k, max(size) AS size, bool_or(startup) AS startup FROM f GROUP BY 1),
b AS (SELECT record_id, coalesce(profile.years_of_experience, 0) AS y, {_many("lower(coalesce(profile.current_title, ''))", C.ROLE_WORDS)} AS role FROM candidates)
SELECT b.record_id, round(y, 6) AS years_of_experience,
  round(CASE WHEN y < 2 THEN 0 WHEN y <= 6 THEN (y - 2) / 4 WHEN y <= 8 THEN 1 WHEN y <= 12 THEN greatest(0.5, 1 - (y - 8) / 8) ELSE greatest(0.2, 0.5 - (y - 12) / 20) END, 6) AS yoe_fit_score,
  CAST(coalesce(product, 0) AS DOUBLE) AS product_company_months, round(CASE WHEN total > 0 THEN coalesce(product, 0) / total ELSE 0 END, 6) AS product_company_ratio,
  round(least(1.0::DOUBLE, role / 3), 6) AS current_role_relevance, CAST(coalesce(only_it, false) AS DOUBLE) AS ever_at_it_services_only,
  CAST(coalesce(longest, 0) AS DOUBLE) AS longest_tenure_months, round(coalesce(mean, 0), 6) AS avg_tenure_months, CAST(coalesce(k >= 3 AND mean < 18, false) AS DOUBLE) AS title_chaser_flag,
  CAST(coalesce(size, 0) AS DOUBLE) AS max_company_size, CAST(coalesce(startup, false) AS DOUBLE) AS startup_experience, CAST({_many('t', C.PRODUCTION)} AS DOUBLE) AS production_signal_count
FROM b JOIN texts ON texts.record_id = b.record_id LEFT JOIN a ON a.record_id = b.record_id
"""
EDUCATION_SQL = f"""
WITH {_SCHOOLS},
a AS (SELECT record_id, max({_case('e.tier', C.TIER_SCORE, 1)}) AS tier, bool_or({_any("lower(coalesce(e.field_of_study, '') || ' ' || coalesce(e.degree, ''))", C.STEM)}) AS stem FROM schools GROUP BY 1)
SELECT c.record_id, CAST(coalesce(tier, 1) AS DOUBLE) AS best_edu_tier, CAST(coalesce(stem, false) AS DOUBLE) AS stem_degree FROM candidates AS c LEFT JOIN a ON a.record_id = c.record_id
"""
LOGISTICS_SQL = f"""
SELECT record_id, CAST(coalesce(profile.country = 'India', false) AS DOUBLE) AS india_location,
  CAST({_any("lower(coalesce(profile.location, '') || ' ' || coalesce(profile.country, ''))", C.CITIES)} AS DOUBLE) AS preferred_city_match,
  CAST(coalesce(redrob_signals.willing_to_relocate, false) AS DOUBLE) AS willing_to_relocate,
  round(CASE WHEN d <= 30 THEN 0 WHEN d >= 180 THEN 1 ELSE (d - 30) / 150 END, 6) AS notice_penalty,
  CAST(NOT (coalesce(redrob_signals.expected_salary_range_inr_lpa.max, 0) < 25 OR coalesce(redrob_signals.expected_salary_range_inr_lpa.min, 0) > 60) AS DOUBLE) AS salary_in_range,
  CASE WHEN lower(redrob_signals.preferred_work_mode) IN ('hybrid', 'flexible', 'onsite') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS work_mode_match
FROM (SELECT *, coalesce(redrob_signals.notice_period_days, 90) AS d FROM candidates)
"""
BEHAVIOUR_SQL = f"""
WITH b AS (
  SELECT record_id, redrob_signals AS r, CASE WHEN coalesce(redrob_signals.last_active_date, '') = '' THEN 0.0::DOUBLE
    ELSE greatest(0.0::DOUBLE, 1 - coalesce(DATE '{C.REF_DATE}' - {_dated('redrob_signals.last_active_date')}, 0) / 180) END AS recency FROM candidates)
SELECT record_id, round(recency, 6) AS recency_score, CAST(coalesce(r.open_to_work_flag, false) AS DOUBLE) AS open_to_work, round(coalesce(r.recruiter_response_rate, 0), 6) AS recruiter_response_rate,
  round(coalesce(r.interview_completion_rate, 0), 6) AS interview_completion_rate, round(ln(1 + coalesce(r.applications_submitted_30d, 0)), 6) AS applications_30d,
  round(coalesce(r.profile_completeness_score, 0) / 100, 6) AS profile_completeness, round(ln(1 + coalesce(r.saved_by_recruiters_30d, 0)), 6) AS saved_by_recruiters_30d,
  CAST(coalesce(r.verified_email, false) AS DOUBLE) + CAST(coalesce(r.verified_phone, false) AS DOUBLE) AS verified_contact,
  round(least(1.1::DOUBLE, greatest(0.0::DOUBLE, pow(recency, 0.5) * pow(coalesce(r.recruiter_response_rate, 0), 0.3) * pow(coalesce(r.interview_completion_rate, 0), 0.2) * (CASE WHEN coalesce(r.open_to_work_flag, false) THEN 1.1 ELSE 0.9 END))), 6) AS behavioral_composite
FROM b
"""
LEVELS_SQL = f"""
WITH {_SKILLS}, v AS (SELECT s.proficiency AS proficiency, m[s.name] AS v FROM skills WHERE m[s.name] IS NOT NULL AND s.proficiency IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY proficiency ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY proficiency) AS n FROM v)
SELECT proficiency, any_value(n) AS n, round(avg(v), 4) AS mean, min(v) AS least, max(v) AS most,
  {', '.join(f'min(v) FILTER (k = CAST(floor(CAST(n AS DOUBLE) * {p}::DOUBLE) AS BIGINT)) AS p{int(p * 100)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))}
FROM r GROUP BY 1
"""

_ITEXT = """itext AS (SELECT record_id, array_to_string(list_filter(list_concat([profile.headline, profile.summary, profile.current_title],
  flatten(list_transform(list_filter(coalesce(career_history, []), lambda j: j IS NOT NULL), lambda j: [j.title, j.description])), list_transform(list_filter(coalesce(skills, []), lambda s: s IS NOT NULL), lambda s: s.name)), lambda x: x IS NOT NULL), ' ') AS text FROM {source})"""
INDEX_TEXT_SQL = f"WITH {_ITEXT.format(source='candidates')} SELECT record_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars FROM itext"
SUMMARY_SQL = f"""
WITH g1 AS ({SKILL_SQL}), g2 AS ({CAREER_SQL}), g3 AS ({EDUCATION_SQL}), g4 AS ({LOGISTICS_SQL}), g5 AS ({BEHAVIOUR_SQL}),
g6 AS (SELECT record_id, CAST(n_findings AS DOUBLE) AS consistency_violation_count, CAST(is_implausible AS DOUBLE) AS is_honeypot FROM ({ROLLUP_SQL})),
wide AS (SELECT * FROM g1 JOIN g2 USING (record_id) JOIN g3 USING (record_id) JOIN g4 USING (record_id) JOIN g5 USING (record_id) JOIN g6 USING (record_id)),
long AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (record_id)) INTO NAME feature VALUE v)
SELECT feature, round(min(v), 6) AS least, round(avg(v), 6) AS mean, round(max(v), 6) AS most, round(avg(CAST(v <> 0 AS INT)), 6) AS nonzero FROM long GROUP BY 1
"""

QUERIES = {
    "record_chunks": (record_chunks, CHUNKS_SQL),
    "record_index_text": (record_index_text, INDEX_TEXT_SQL),
    "latest_delivery": (latest_delivery, LATEST_SQL),
    "record_findings": (record_findings, FINDINGS_SQL),
    "record_rollup": (record_rollup, ROLLUP_SQL),
    "finding_counts": (finding_counts, FINDING_COUNTS_SQL),
    "implausible_share": (implausible_share, IMPLAUSIBLE_SQL),
    "audit_points": (audit_points, AUDIT_SQL),
    "skill_features": (skill_features, SKILL_SQL),
    "career_features": (career_features, CAREER_SQL),
    "education_features": (education_features, EDUCATION_SQL),
    "logistics_features": (logistics_features, LOGISTICS_SQL),
    "behaviour_features": (behaviour_features, BEHAVIOUR_SQL),
    "feature_summary": (feature_summary, SUMMARY_SQL),
    "skill_level_scores": (latest_skill_levels, LEVELS_SQL),
    "expert_threshold_sweep": (expert_threshold_sweep, SWEEP_SQL),
}
