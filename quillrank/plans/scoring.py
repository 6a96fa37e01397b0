"""Training on labels, scoring every considered candidate, and what lowers a score; passages and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.config import BEHAVIOURAL
from quillrank.functions.tables import checkpoint, table
from quillrank.operators import model
from quillrank.operators.text import entries, labelling_payload, rerank_passage
from quillrank.plans.labels import _candidate_scores, _rows, held_out

#: All columns of a feature row, in the order of the reference's vector.
FEATURES = [
    "sim_ideal_max", "sim_ideal_mean", "sim_anti_max", "semantic_contrastive", "sim_jd_summary", "per_req_coverage_mean",
    "per_req_coverage_min", "per_req_coverage_std", "bm25_score", "bm25_rank_pct", "core_skill_count_raw", "core_skill_count_evidenced",
    "skill_evidence_ratio", "nice_skill_count_evidenced", "max_assessment_score_jd", "assessment_coverage", "github_activity_score", "years_of_experience",
    "yoe_fit_score", "product_company_months", "product_company_ratio", "current_role_relevance", "ever_at_it_services_only", "longest_tenure_months",
    "avg_tenure_months", "title_chaser_flag", "max_company_size", "startup_experience", "production_signal_count", "best_edu_tier",
    "stem_degree", "india_location", "preferred_city_match", "willing_to_relocate", "notice_penalty", "salary_in_range",
    "work_mode_match", "recency_score", "open_to_work", "recruiter_response_rate", "interview_completion_rate", "applications_30d",
    "profile_completeness", "saved_by_recruiters_30d", "verified_contact", "behavioral_composite", "consistency_violation_count", "is_honeypot",
]
#: At most; growing ends earlier by the error on the validation side.
ROUNDS = 500


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).join(_candidate_scores(spark, sf_dir), "candidate_id").select("candidate_id", "label", held_out().alias("held_out"), *FEATURES)


_TRAINED: dict[tuple[str, str], model.GBTRegressionModel] = {}


def trained(spark: SparkSession, sf_dir: str) -> model.GBTRegressionModel:
    """The model of these tables: trained at the first call of an application, then taken again. Tables are not written to."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = model.train(checkpoint(_training(spark, sf_dir)), FEATURES, "label", ROUNDS, "held_out")
    return _TRAINED[key]


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = model.predict(trained(spark, sf_dir), _rows(spark, sf_dir).select("search_id", "candidate_id", *FEATURES), FEATURES)
    return scored.select("search_id", "candidate_id", "score")


def model_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each considered row the bias and each feature's contribution, and the two that lower it most."""
    rows = _rows(spark, sf_dir).select(F.concat_ws("|", "search_id", "candidate_id").alias("row_key"), *FEATURES)
    parts = model.contributions(trained(spark, sf_dir), rows, FEATURES, "row_key")
    low = model.most_negative(F.col("contributions"), FEATURES)
    return parts.select("row_key", "bias", "contributions", F.array_join(low["feature"], ",").alias("lowered_by"))


def model_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether bias and contributions of each considered row add up to its score."""
    booster = trained(spark, sf_dir)
    rows = _rows(spark, sf_dir).select(F.concat_ws("|", "search_id", "candidate_id").alias("row_key"), *FEATURES)
    scores = model.predict(booster, rows, FEATURES).select("row_key", "score")
    parts = model.contributions(booster, rows, FEATURES, "row_key").select("row_key", (F.col("bias") + F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x)).alias("whole"), F.size("contributions").alias("n_features"))
    return scores.join(parts, "row_key").select("row_key", "n_features", (F.abs(F.col("score") - F.col("whole")) < 1e-6).alias("adds_up"))


def feature_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen features of greatest gain."""
    gains = model.importances(trained(spark, sf_dir), FEATURES)
    return spark.createDataFrame([(k + 1, f, g) for k, (f, g) in enumerate(gains)], "place int, feature string, gain double")


#: Features put to zero in each ablation.
ABLATIONS = {
    "no_behavioral": BEHAVIOURAL,
    "no_anti_persona": ["sim_anti_max", "semantic_contrastive"],
    "no_consistency": ["consistency_violation_count"],
    "bm25_only": [f for f in FEATURES if f.startswith("sim_") or "dense" in f],
    "dense_only": ["bm25_score", "bm25_rank_pct"],
}


def ablation_runs(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS) -> DataFrame:
    """A model trained anew without each group of features, and its quality on the held-out side."""
    return model.ablations(checkpoint(_training(spark, sf_dir)), FEATURES, "label", ABLATIONS, rounds, "held_out")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").select("record_id", F.md5(rerank_passage()).alias("passage_md5"), F.length(rerank_passage()).alias("n_chars"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").select("record_id", labelling_payload().alias("payload"))


def career_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record: number of jobs, the company held longest (the first of equals), distinct companies in order."""
    jobs = entries("career_history")
    lasting = F.aggregate(
        jobs,
        F.struct(F.lit(0).alias("m"), F.lit("").alias("c")),
        lambda a, j: F.when(F.coalesce(j["duration_months"], F.lit(0)) > a["m"], F.struct(j["duration_months"].alias("m"), F.coalesce(j["company"], F.lit("")).alias("c"))).otherwise(a),
    )
    return table(spark, sf_dir, "candidates").select("record_id", F.size(jobs).alias("n_jobs"), lasting["c"].alias("longest_at"), lasting["m"].alias("longest_months"), F.size(F.array_distinct(F.transform(jobs, lambda j: F.lower(F.coalesce(j["company"], F.lit("")))))).alias("n_companies"))


_JOBS = "jobs AS (SELECT record_id, pos, j FROM (SELECT record_id, unnest(career_history) AS j, generate_subscripts(career_history, 1) AS pos FROM candidates) WHERE j IS NOT NULL)"
QUERIES = {
    "model_scores": (model_scores, None),
    "model_contributions": (model_contributions, None),
    "model_sums": (model_sums, "SELECT DISTINCT concat_ws('|', search_id, candidate_id) AS row_key, 48 AS n_features, true AS adds_up FROM feature_rows WHERE search_id IS NOT NULL AND candidate_id IS NOT NULL"),
    "feature_gains": (feature_gains, None),
    "rerank_passages": (
        passages,
        f"""WITH {_JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS k FROM jobs),
d AS (SELECT record_id, string_agg(substr(j.description, 1, 200), ' ' ORDER BY k) AS t FROM n WHERE k <= 3 GROUP BY 1)
SELECT c.record_id, md5(substr(concat_ws(' ', profile.summary, profile.headline, t), 1, 512)) AS passage_md5, CAST(length(substr(concat_ws(' ', profile.summary, profile.headline, t), 1, 512)) AS INT) AS n_chars
FROM candidates AS c LEFT JOIN d ON d.record_id = c.record_id""",
    ),
    "labelling_payloads": (payloads, None),
    "career_summaries": (
        career_summaries,
        f"""WITH {_JOBS}, n AS (SELECT record_id, count(*) AS n, count(DISTINCT lower(coalesce(j.company, ''))) AS k FROM jobs GROUP BY 1),
l AS (SELECT record_id, coalesce(j.company, '') AS c, j.duration_months AS m FROM jobs WHERE j.duration_months > 0 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY j.duration_months DESC, pos) = 1)
SELECT c.record_id, CAST(coalesce(n.n, 0) AS INT) AS n_jobs, coalesce(l.c, '') AS longest_at, CAST(coalesce(l.m, 0) AS INT) AS longest_months, CAST(coalesce(n.k, 0) AS INT) AS n_companies
FROM candidates AS c LEFT JOIN n ON n.record_id = c.record_id LEFT JOIN l ON l.record_id = c.record_id""",
    ),
}
