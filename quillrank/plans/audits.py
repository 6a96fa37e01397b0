"""Tiered audits of records, short facts of a record, label joins and batches with their prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions import config as C
from quillrank.functions.tables import table
from quillrank.operators import consistency, metrics
from quillrank.operators.text import any_contains, entries, half_even, labelling_payload, percent, profile_text, year_month
from quillrank.plans import records


def tiers() -> Column:
    """array<struct<tier, code>> of a record: HARD is a contradiction, SOFT improbable, NOTE a weak sign."""
    jobs, skills, schools = entries("career_history"), entries("skills"), entries("education")
    yoe = F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0))
    signals = lambda k: F.coalesce(F.col(f"redrob_signals.{k}"), F.lit(""))
    excess = yoe - (C.REF_YEAR - F.array_max(F.filter(F.transform(schools, lambda e: e["end_year"]), lambda y: y != 0)) + 1.5)
    over = lambda j: j["duration_months"] - consistency._months(j)
    worked = F.aggregate(jobs, F.lit(0), lambda s, j: s + F.coalesce(j["duration_months"], F.lit(0)))
    idle = F.datediff(F.to_date(F.lit(C.REF_DATE)), consistency.plain_date(F.col("redrob_signals.last_active_date")))
    n = consistency.experts(skills)

    def found(tier: str, code: str, times: Column) -> Column:
        return F.array_repeat(F.struct(F.lit(tier).alias("tier"), F.lit(code).alias("code")), F.coalesce(times.cast("int"), F.lit(0)))

    return F.concat(
        found("HARD", "yoe_span", yoe > C.REF_YEAR - F.array_min(consistency._start_years(jobs)) + 2),
        found("HARD", "tenure", consistency._count(jobs, lambda j: (j["duration_months"] != 0) & (over(j) > 12))),
        found("SOFT", "tenure", consistency._count(jobs, lambda j: (j["duration_months"] != 0) & (over(j) > 6) & (over(j) <= 12))),
        found("HARD", "expert_zero", consistency._count(skills, lambda s: (s["proficiency"] == "expert") & (s["duration_months"] == 0)) > 0),
        found("SOFT", "grad_gap", excess > 4),
        found("NOTE", "grad_gap", (excess > 0) & (excess <= 4)),
        found("SOFT", "signup_late", (signals("signup_date") != "") & (signals("last_active_date") != "") & (signals("signup_date") > signals("last_active_date"))),
        found("SOFT", "overlap", consistency.overlaps(jobs) > 0),
        found("NOTE", "months_sum", (yoe > 0) & (worked > yoe * 12 + 24)),
        found("SOFT", "experts", n >= 10),
        found("NOTE", "experts", (n >= 8) & (n < 10)),
        found("NOTE", "invented_company", consistency._count(jobs, lambda j: any_contains(F.lower(F.coalesce(j["company"], F.lit(""))), C.INVENTED_COMPANIES))),
        found("NOTE", "low_response", F.coalesce(F.col("redrob_signals.recruiter_response_rate"), F.lit(1.0)) < 0.10),
        found("NOTE", "inactive", idle > 180),
    )


def audit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each finding of each tier stands against each record."""
    each = table(spark, sf_dir, "candidates").select("record_id", F.inline(tiers()))
    return each.groupBy("record_id", "tier", "code").agg(F.count(F.lit(1)).alias("n"))


def audit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of each search with their audit: suspicious, note_only, clean, or missing where no profile is known."""
    rows = table(spark, sf_dir, "feature_rows").where("search_id is not null and candidate_id is not null").dropDuplicates(["search_id", "candidate_id"])
    w = W.partitionBy("search_id").orderBy(F.desc_nulls_last(F.round(F.col("sim_ideal_max").cast("double"), 6)), "candidate_id")
    first = rows.select("search_id", "candidate_id", F.row_number().over(w).alias("rank")).where("rank <= 100")
    c = table(spark, sf_dir, "candidates").where("candidate_id is not null").select("candidate_id", F.struct("received_at", "record_id").alias("_o"), tiers()["tier"].alias("_t"))
    last = c.groupBy("candidate_id").agg(F.max(F.struct("_o", "_t"))["_t"].alias("_t"))
    bucket = F.when(F.col("_t").isNull(), "missing").when(F.arrays_overlap("_t", F.array(F.lit("HARD"), F.lit("SOFT"))), "suspicious").when(F.size("_t") > 0, "note_only").otherwise("clean")
    return first.join(last, "candidate_id", "left").select("search_id", "candidate_id", "rank", bucket.alias("bucket"))


def record_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short facts of a record: first small company held over half a year, first two product companies, best school,
    kind of company, month last active, behaviour sum, years and response rate as written."""
    jobs = entries("career_history")
    name = lambda j: F.coalesce(j["company"], F.lit(""))
    lasting = lambda j: F.coalesce(j["duration_months"] > 6, F.lit(False))
    small = F.filter(jobs, lambda j: F.coalesce(j["company_size"].isin(C.STARTUP_SIZES), F.lit(False)) & lasting(j))
    product = F.filter(jobs, lambda j: (name(j) != "") & ~any_contains(F.lower(name(j)), C.IT_SERVICES) & lasting(j))
    names = F.aggregate(product, F.array().cast("array<string>"), lambda a, j: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(name(j))), a).otherwise(F.array_append(a, name(j))))
    rank = lambda e: sum((F.when(e["tier"] == k, v).otherwise(0) for k, v in C.TIER_SCORE.items()), F.lit(0))
    best = F.aggregate(entries("education"), F.struct(F.lit(0).alias("r"), F.lit("").alias("n")), lambda a, e: F.when(rank(e) > a["r"], F.struct(rank(e).alias("r"), F.coalesce(e["institution"], F.lit("")).alias("n"))).otherwise(a))
    size = F.col("profile.current_company_size")
    kind = F.when(size.isin(C.STARTUP_SIZES), "startup").when(size.isin("201-500", "501-1000"), "mid-size company").otherwise("large company")
    s = lambda k: F.coalesce(F.col(f"redrob_signals.{k}"), F.lit(0.0))
    return table(spark, sf_dir, "candidates").select(
        "record_id", F.coalesce(F.get(F.transform(small, name), F.lit(0)), F.lit("")).alias("small_company"), F.array_join(F.slice(names, 1, 2), " | ").alias("product_companies"), best["n"].alias("best_school"), kind.alias("company_kind"),
        year_month(F.col("redrob_signals.last_active_date")).alias("active_in"), F.round(s("recruiter_response_rate") + s("interview_completion_rate"), 6).alias("behaviour_sum"),
        half_even(F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0))).alias("years"), percent(s("recruiter_response_rate")).alias("response"), F.md5(profile_text()).alias("text_md5"),
    )


def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labels round to each fifth, halves to the even side."""
    good = table(spark, sf_dir, "label_results").where("score is not null and not isnan(score)")
    return good.groupBy(F.bround(F.col("score") * 5).cast("int").alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def label_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each real label with the stratum of its name in the targets, 'unknown' where there is none; anchors, which are
    no candidates, are left out by a semi-join."""
    labels = table(spark, sf_dir, "label_results").select("label_id", "candidate_id", F.regexp_replace(F.regexp_replace(F.lower("stratum"), "[^a-z0-9]+", "_"), "^_+|_+$", "").alias("_s"))
    targets = table(spark, sf_dir, "stratum_targets").select(F.col("stratum").alias("_s"), F.col("stratum"))
    real = labels.join(table(spark, sf_dir, "candidates").select("candidate_id"), "candidate_id", "left_semi")
    return real.join(targets, "_s", "left").select("label_id", "candidate_id", F.coalesce("stratum", F.lit("unknown")).alias("stratum"))


def queries_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated texts and vectors brought together by their place: a row of the one list, the vector of the other."""
    texts = spark.createDataFrame([(C.WANTED_TEXTS + C.UNWANTED_TEXTS,)], "texts array<string>").select(F.posexplode("texts").alias("place", "text"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("place"), F.size("embedding").alias("n_places"))
    return texts.join(v, "place").select("place", "text", (F.col("place") < len(C.WANTED_TEXTS)).alias("is_wanted"), "n_places")


RUBRIC_TEXT = "Grade each candidate for the stated role with one of 0.0, 0.2, 0.4, 0.6, 0.8 and 1.0."


def label_prompts(spark: SparkSession, sf_dir: str, per_prompt: int = 10) -> DataFrame:
    """Prompts for a labeller: rubric, and the payloads of up to ten candidates in order of their record, as JSON.

    Records are put into buckets by id, and batches are cut within a bucket, so no task numbers all of them.
    """
    rows = table(spark, sf_dir, "candidates").select("record_id", F.floor(F.col("record_id") / 1000).alias("bucket"), labelling_payload().alias("_p"))
    at = F.row_number().over(W.partitionBy("bucket").orderBy("record_id"))
    batches = rows.withColumn("batch", F.floor((at - 1) / per_prompt).cast("int")).groupBy("bucket", "batch").agg(F.array_sort(F.collect_list(F.struct("record_id", "_p"))).alias("_l"))
    prompt = F.concat(F.lit(RUBRIC_TEXT + "\n["), F.array_join(F.transform("_l", lambda x: x["_p"]), ","), F.lit("]"))
    return batches.select("bucket", "batch", F.size("_l").alias("n"), F.col("_l")[0]["record_id"].alias("first_record"), prompt.alias("prompt"))


def prompt_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each prompt its place, number of payloads and first record; each reads back as a JSON list of that many."""
    p = label_prompts(spark, sf_dir)
    read = F.size(F.from_json(F.regexp_extract("prompt", r"(?s)\n(\[.*\])$", 1), "array<struct<candidate_id:string>>"))
    return p.select("bucket", "batch", "n", "first_record", (read == F.col("n")).alias("reads_back"))


TIERS_SQL = f"""
WITH {records._JOBS}, {records._SKILLS}, {records._SCHOOLS},
base AS (SELECT record_id, coalesce(profile.years_of_experience, 0) AS yoe, coalesce(redrob_signals.signup_date, '') AS su, coalesce(redrob_signals.last_active_date, '') AS la, redrob_signals.recruiter_response_rate AS rr FROM candidates),
spans AS (SELECT record_id, j.duration_months AS dm, {records._dated('j.start_date')} AS s, j.end_date IS NULL AS open, {records._dated('j.end_date')} AS e FROM jobs),
over AS (SELECT record_id, dm - (((CASE WHEN open THEN 2026 ELSE year(e) END) - year(s)) * 12 + (CASE WHEN open THEN 6 ELSE month(e) END) - month(s)) AS o FROM spans WHERE dm <> 0),
closed AS (SELECT record_id, pos, j.start_date AS s, j.end_date AS e FROM jobs WHERE NOT coalesce(j.is_current, false) AND coalesce(j.start_date, '') <> '' AND coalesce(j.end_date, '') <> ''),
per_job AS (SELECT record_id, sum(coalesce(j.duration_months, 0)) AS worked, min(CASE WHEN regexp_matches(substr(j.start_date, 1, 4), '^\\d{{4}}$') THEN CAST(substr(j.start_date, 1, 4) AS INT) END) AS first FROM jobs GROUP BY 1),
grad AS (SELECT record_id, yoe - (2026 - g + 1.5::DOUBLE) AS x FROM base JOIN (SELECT record_id, max(e.end_year) AS g FROM schools WHERE e.end_year <> 0 GROUP BY 1) USING (record_id)),
ex AS (SELECT record_id, count(*) AS n FROM skills WHERE s.proficiency = 'expert' GROUP BY 1),
found AS (
  SELECT record_id, 'HARD' AS tier, 'yoe_span' AS code, 1 AS n FROM base JOIN per_job USING (record_id) WHERE yoe > 2026 - first + 2
  UNION ALL SELECT record_id, CASE WHEN o > 12 THEN 'HARD' ELSE 'SOFT' END, 'tenure', count(*) FROM over WHERE o > 6 GROUP BY 1, 2
  UNION ALL SELECT DISTINCT record_id, 'HARD', 'expert_zero', 1 FROM skills WHERE s.proficiency = 'expert' AND s.duration_months = 0
  UNION ALL SELECT record_id, CASE WHEN x > 4 THEN 'SOFT' ELSE 'NOTE' END, 'grad_gap', 1 FROM grad WHERE x > 0
  UNION ALL SELECT record_id, 'SOFT', 'signup_late', 1 FROM base WHERE su <> '' AND la <> '' AND su > la
  UNION ALL SELECT DISTINCT a.record_id, 'SOFT', 'overlap', 1 FROM closed AS a JOIN closed AS b ON a.record_id = b.record_id AND a.pos < b.pos AND a.s < b.e AND b.s < a.e
  UNION ALL SELECT record_id, 'NOTE', 'months_sum', 1 FROM base JOIN per_job USING (record_id) WHERE yoe > 0 AND worked > yoe * 12 + 24
  UNION ALL SELECT record_id, CASE WHEN n >= 10 THEN 'SOFT' ELSE 'NOTE' END, 'experts', 1 FROM ex WHERE n >= 8
  UNION ALL SELECT record_id, 'NOTE', 'invented_company', count(*) FROM jobs WHERE {records._any("lower(coalesce(j.company, ''))", C.INVENTED_COMPANIES)} GROUP BY 1
  UNION ALL SELECT record_id, 'NOTE', 'low_response', 1 FROM base WHERE coalesce(rr, 1) < 0.10
  UNION ALL SELECT record_id, 'NOTE', 'inactive', 1 FROM base WHERE DATE '{C.REF_DATE}' - {records._dated('la')} > 180)
"""
BUCKETS_SQL = TIERS_SQL + """,
r AS (SELECT DISTINCT ON (search_id, candidate_id) * FROM feature_rows WHERE search_id IS NOT NULL AND candidate_id IS NOT NULL),
first AS (SELECT search_id, candidate_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY round(CAST(sim_ideal_max AS DOUBLE), 6) DESC NULLS LAST, candidate_id) AS INT) AS rank FROM r QUALIFY rank <= 100),
last AS (SELECT candidate_id, arg_max(record_id, (received_at, record_id)) AS record_id FROM candidates WHERE candidate_id IS NOT NULL GROUP BY 1),
worst AS (SELECT record_id, bool_or(tier <> 'NOTE') AS bad FROM found GROUP BY 1)
SELECT f.search_id, f.candidate_id, f.rank, CASE WHEN l.record_id IS NULL THEN 'missing' WHEN w.bad THEN 'suspicious' WHEN w.record_id IS NOT NULL THEN 'note_only' ELSE 'clean' END AS bucket
FROM first AS f LEFT JOIN last AS l USING (candidate_id) LEFT JOIN worst AS w ON w.record_id = l.record_id
"""
FACTS_SQL = f"""
WITH {records._JOBS}, {records._SCHOOLS},
small AS (SELECT record_id, arg_min(coalesce(j.company, ''), pos) AS c FROM jobs WHERE j.company_size IN ('1-10', '11-50', '51-200') AND j.duration_months > 6 GROUP BY 1),
prod AS (SELECT record_id, lower(j.company) AS k, arg_min(j.company, pos) AS c, min(pos) AS p FROM jobs WHERE coalesce(j.company, '') <> '' AND NOT {records._any("lower(j.company)", C.IT_SERVICES)} AND j.duration_months > 6 GROUP BY 1, 2),
two AS (SELECT record_id, string_agg(c, ' | ' ORDER BY p) AS c FROM (SELECT * FROM prod QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY p) <= 2) GROUP BY 1),
ranked AS (SELECT record_id, e, pos, {records._case('e.tier', C.TIER_SCORE, 0)} AS r FROM (SELECT record_id, unnest(education) AS e, generate_subscripts(education, 1) AS pos FROM candidates) WHERE e IS NOT NULL),
best AS (SELECT record_id, arg_min(coalesce(e.institution, ''), (-r, pos)) AS n FROM ranked WHERE r > 0 GROUP BY 1),
t AS (SELECT record_id, array_to_string(list_filter(list_concat([profile.headline, profile.summary],
  list_transform(list_filter(coalesce(career_history, []), lambda j: j IS NOT NULL), lambda j: coalesce(j.title, '') || ' at ' || coalesce(j.company_size, '') || ': ' || coalesce(j.description, '')),
  list_transform(list_filter(coalesce(skills, []), lambda s: s IS NOT NULL), lambda s: s.name)), lambda x: x <> ''), ' ') AS text FROM candidates)
SELECT c.record_id, coalesce(small.c, '') AS small_company, coalesce(two.c, '') AS product_companies, coalesce(best.n, '') AS best_school,
  CASE WHEN profile.current_company_size IN ('1-10', '11-50', '51-200') THEN 'startup' WHEN profile.current_company_size IN ('201-500', '501-1000') THEN 'mid-size company' ELSE 'large company' END AS company_kind,
  substr(coalesce(redrob_signals.last_active_date, ''), 1, 7) AS active_in, round(coalesce(redrob_signals.recruiter_response_rate, 0) + coalesce(redrob_signals.interview_completion_rate, 0), 6) AS behaviour_sum,
  CAST(CAST(round_even(coalesce(profile.years_of_experience, 0), 0) AS BIGINT) AS VARCHAR) AS years, CAST(CAST(round_even(coalesce(redrob_signals.recruiter_response_rate, 0) * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS response, md5(t.text) AS text_md5
FROM candidates AS c JOIN t ON t.record_id = c.record_id LEFT JOIN small ON small.record_id = c.record_id LEFT JOIN two ON two.record_id = c.record_id LEFT JOIN best ON best.record_id = c.record_id
"""
QUERIES = {
    "audit_tiers": (audit_tiers, TIERS_SQL + "SELECT record_id, tier, code, CAST(sum(n) AS BIGINT) AS n FROM found GROUP BY 1, 2, 3"),
    "audit_buckets": (audit_buckets, BUCKETS_SQL),
    "record_facts": (record_facts, FACTS_SQL),
    "grade_counts": (grade_counts, "SELECT CAST(round_even(score * 5, 0) AS INT) AS grade, count(*) AS n FROM label_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1"),
    "label_strata": (label_strata, "SELECT label_id, candidate_id, coalesce(t.stratum, 'unknown') AS stratum FROM label_results AS l LEFT JOIN stratum_targets AS t ON t.stratum = trim(regexp_replace(lower(l.stratum), '[^a-z0-9]+', '_', 'g'), '_') WHERE candidate_id IN (SELECT candidate_id FROM candidates)"),
    "queries_by_place": (queries_by_place, "SELECT place, text, place < 5 AS is_wanted, CAST(len(e.embedding) AS INT) AS n_places FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(C.WANTED_TEXTS + C.UNWANTED_TEXTS)) + ") AS v(place, text) JOIN embeddings AS e ON e.vec_id = place"),
    "prompt_sizes": (prompt_sizes, "WITH n AS (SELECT record_id, CAST(floor(record_id / 1000) AS BIGINT) AS bucket, CAST(floor((row_number() OVER (PARTITION BY floor(record_id / 1000) ORDER BY record_id) - 1) / 10) AS INT) AS batch FROM candidates) SELECT bucket, batch, CAST(count(*) AS INT) AS n, min(record_id) AS first_record, true AS reads_back FROM n GROUP BY 1, 2"),
}
