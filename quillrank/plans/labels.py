"""Queries over labels and feature rows: score distributions, agreement, metrics, sampling, set operations, output checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions import config as C
from quillrank.functions.tables import checkpoint, kept, table
from quillrank.operators import metrics, ranking

MEASURES = ["sim_ideal_max", "bm25_score", "behavioral_composite", "skill_evidence_ratio"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "label_results")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_rows with each candidate of a search once: rows given twice are equal."""
    return table(spark, sf_dir, "feature_rows").where("search_id is not null and candidate_id is not null").dropDuplicates(["search_id", "candidate_id"])


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def nearest_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = _labels(spark, sf_dir).where("score is not null and not isnan(score)").select("label_id", metrics.nearest_grade(F.col("score"), C.RUBRIC).alias("grade"))
    return grades


def _candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _labels(spark, sf_dir).where("candidate_id is not null and score is not null and not isnan(score)")
    return good.groupBy("candidate_id").agg(F.avg(metrics.nearest_grade(F.col("score"), C.RUBRIC)).alias("label"))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a candidate's mean label in odd and in even runs, where both exist."""
    good = _labels(spark, sf_dir).where("candidate_id is not null and score is not null and not isnan(score)")
    halves = good.groupBy("candidate_id").agg(F.avg(F.when(F.col("run_id") % 2 == 1, F.col("score"))).alias("a"), F.avg(F.when(F.col("run_id") % 2 == 0, F.col("score"))).alias("b")).where("a is not null and b is not null")
    return halves.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("a", "b"), 6).alias("r"))


def labels_last_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label of each run and candidate: the last written."""
    good = _labels(spark, sf_dir).where("run_id is not null and candidate_id is not null")
    last = good.groupBy("run_id", "candidate_id").agg(F.max(F.struct("labelled_at", "label_id"))["label_id"].alias("label_id"), F.count(F.lit(1)).alias("n"))
    return last


def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("search_id", "candidate_id", F.col("bm25_score").cast("double").alias("s"))
    return ranking.min_max(rows, ["search_id"], "s").select("search_id", "candidate_id", F.round("norm", 6).alias("norm"))


def final_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of each search by one score rounded as written out, ties by id."""
    rows = _rows(spark, sf_dir).select("search_id", "candidate_id", F.round(F.col("sim_ideal_max").cast("double"), 6).alias("score"))
    w = W.partitionBy("search_id").orderBy(F.desc_nulls_last("score"), "candidate_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 100").select("search_id", "candidate_id", "rank", "score")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept, as metrics use it several times."""
    scores = _candidate_scores(spark, sf_dir)
    return kept(_rows(spark, sf_dir).select("search_id", "candidate_id", F.col("sim_ideal_max").cast("double").alias("s")).join(scores, "candidate_id"))


def ndcg_by_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, by = _judged(spark, sf_dir), [F.desc_nulls_last("s"), F.col("candidate_id")]
    ten, fifty = metrics.ndcg(j, "search_id", by, "label", 10), metrics.ndcg(j, "search_id", by, "label", 50)
    return ten.select("search_id", F.round("ndcg", 6).alias("ndcg_10")).join(fifty.select("search_id", F.round("ndcg", 6).alias("ndcg_50")), "search_id")


def composite_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half NDCG at 10, 0.3 NDCG at 50, 0.15 average precision, 0.05 precision at 10, for each search."""
    j, by = _judged(spark, sf_dir), [F.desc_nulls_last("s"), F.col("candidate_id")]
    ten, fifty = metrics.ndcg(j, "search_id", by, "label", 10).withColumnRenamed("ndcg", "a"), metrics.ndcg(j, "search_id", by, "label", 50).withColumnRenamed("ndcg", "b")
    pm = metrics.precision_and_map(j, "search_id", by, F.col("label") >= 0.5, 10)
    every = ten.join(fifty, "search_id").join(pm, "search_id")
    return every.select("search_id", F.round("precision", 6).alias("precision_10"), F.round("average_precision", 6).alias("average_precision"), F.round(0.5 * F.col("a") + 0.3 * F.col("b") + 0.15 * F.col("average_precision") + 0.05 * F.col("precision"), 6).alias("composite"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_rows(spark, sf_dir).select(F.col("bm25_score").cast("double").alias("v")), "v")


def measure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in MEASURES))).alias("x"))
    return rows.groupBy("x.measure").agg(F.count("x.v").alias("n"), F.round(F.min("x.v"), 4).alias("least"), F.round(F.avg("x.v"), 4).alias("mean"), F.round(F.max("x.v"), 4).alias("most"), F.round(F.avg((F.col("x.v") != 0).cast("int")), 6).alias("nonzero"))


def ablated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed weighted score per row, whole and with groups of features set to zero."""
    rows = _rows(spark, sf_dir)
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    parts = {"dense": z("sim_ideal_max") - 0.4 * z("sim_anti_max"), "skills": z("skill_evidence_ratio") + 0.1 * z("core_skill_count_evidenced"), "behaviour": z("behavioral_composite") + 0.2 * z("recruiter_response_rate")}
    whole = sum(parts.values(), F.lit(0.0))
    return rows.select("search_id", "candidate_id", F.round(whole, 4).alias("whole"), *(F.round(whole - v, 4).alias(f"no_{k}") for k, v in parts.items()))


def _folded(c: str = "stratum"):
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(_labels(spark, sf_dir).where("candidate_id is not null").select("candidate_id", _folded().alias("stratum")).distinct())


def _drawn(units: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Candidates of ``units`` (candidate_id, stratum) drawn in the fixed order of strata, each at most once, up to a quota a stratum.

    A candidate goes to the first stratum that takes it. Each stratum is a top-k by a seeded hash of the
    candidates not drawn so far: one anti-join with at most the quotas' sum of ids, broadcast by that bound.
    """
    drawn = None
    for name, quota in quotas.items():
        pool = units.where(F.col("stratum") == name)
        if drawn is not None:
            pool = pool.join(F.broadcast(drawn.select("candidate_id")), "candidate_id", "left_anti")
        part = pool.select("candidate_id", F.lit(name).alias("stratum"), F.md5(F.concat("candidate_id", F.lit("|"), F.lit(name), F.lit("|42"))).alias("_h")).orderBy("_h", "candidate_id").limit(quota).drop("_h")
        # At most a quota of rows; kept, so that a later stratum does not draw the earlier ones again.
        part = checkpoint(part)
        drawn = part if drawn is None else drawn.unionByName(part)
    return drawn


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(_units(spark, sf_dir), dict.fromkeys(STRATA, C.QUOTA))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelling sample with the reference's own quota of each stratum, 2,500 in all."""
    return _drawn(_units(spark, sf_dir), C.QUOTAS)


STRATA = ["top_retrieval_bm25", "top_retrieval_dense", "top_anti_persona_sim", "title_match_strong", "title_mismatch", "consulting_only", "honeypot_flagged", "high_behavioral", "low_behavioral", "tier1_education", "random"]


def held_out() -> Column:
    """Whether a candidate is on the validation side: a fifth, by the hash of its id."""
    return F.conv(F.substring(F.md5("candidate_id"), 1, 4), 16, 10).cast("int") < 13107


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training or validation side of each labelled candidate, by the hash of its id: the same on every run."""
    side = F.when(held_out(), "validation").otherwise("training")
    return _candidate_scores(spark, sf_dir).select("candidate_id", side.alias("side"))


def labelled_and_considered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a label that are in a search: a semi-join on distinct ids."""
    return _labels(spark, sf_dir).select("candidate_id").distinct().join(table(spark, sf_dir, "feature_rows").select("candidate_id"), "candidate_id", "left_semi")


def labelled_not_considered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).where("candidate_id is not null").select("candidate_id").distinct().join(table(spark, sf_dir, "feature_rows").select("candidate_id"), "candidate_id", "left_anti")


def all_known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [table(spark, sf_dir, t).select("candidate_id") for t in ("candidates", "label_results", "feature_rows")]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).where("candidate_id is not null").distinct()


def missing_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(search_id, from_place, to_place): the runs of places that a search's written ranking lacks, of 1 to its greatest.

    Places are those of the search's rows by one score with all rows of equal score left out but the first, as a
    ranking with gaps. A run of any length is one row.
    """
    rows = _rows(spark, sf_dir).select("search_id", F.round(F.col("sim_ideal_max").cast("double"), 2).alias("s"))
    places = rows.where("s is not null").withColumn("p", F.rank().over(W.partitionBy("search_id").orderBy(F.desc("s")))).select("search_id", "p").distinct()
    before = F.coalesce(F.lag("p").over(W.partitionBy("search_id").orderBy("p")), F.lit(0))
    return places.withColumn("_b", before).where("p > _b + 1").select("search_id", (F.col("_b") + 1).alias("from_place"), (F.col("p") - 1).alias("to_place"))


def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten of a run's labels in order of their id."""
    w = W.partitionBy("run_id").orderBy("label_id")
    rows = _labels(spark, sf_dir).where("run_id is not null").select("run_id", F.floor((F.row_number().over(w) - 1) / 10).cast("int").alias("batch"))
    return rows.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("n"))


def output_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a ranking written out as text: here ranks by unrounded scores, ids repeated as delivered.

    Codes: bad_id, repeated_id, rising (score above the one before), tie_order (equal scores, ids not ascending).
    The ranks are made here, so they have no gaps; ``ranking_violations`` also checks ranks, rows and numbers.
    """
    rows = table(spark, sf_dir, "feature_rows").where("search_id is not null").select("search_id", "candidate_id", F.coalesce(F.round(F.col("sim_ideal_max").cast("double"), 2), F.lit(0.0)).alias("score"), F.coalesce(F.col("sim_ideal_max").cast("double"), F.lit(0.0)).alias("_s"))
    w = W.partitionBy("search_id").orderBy(F.desc("_s"), "candidate_id")
    ranked = rows.withColumns({"rank": F.row_number().over(w), "_before": F.lag("score").over(w), "_id": F.lag("candidate_id").over(w)})
    row = ranked.select(
        "search_id",
        F.inline(
            F.array(
                F.struct(F.lit("bad_id").alias("code"), F.coalesce(~F.col("candidate_id").rlike("^CAND_[0-9]{7}$"), F.lit(True)).alias("hit")),
                F.struct(F.lit("rising").alias("code"), F.coalesce(F.col("score") > F.col("_before"), F.lit(False)).alias("hit")),
                F.struct(F.lit("tie_order").alias("code"), F.coalesce((F.col("score") == F.col("_before")) & (F.col("candidate_id") < F.col("_id")), F.lit(False)).alias("hit")),
            )
        ),
    )
    per_row = row.where("hit").groupBy("search_id", "code").agg(F.count(F.lit(1)).alias("n"))
    twice = rows.groupBy("search_id", "candidate_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").groupBy("search_id").agg(F.count(F.lit(1)).alias("n")).select("search_id", F.lit("repeated_id").alias("code"), "n")
    return per_row.unionByName(twice)


def ranking_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All output checks over the final rankings of the searches, which have to hold a hundred rows each."""
    return ranking.violations(final_ranking(spark, sf_dir), "search_id")


_ROWS = "r AS (SELECT DISTINCT ON (search_id, candidate_id) * FROM feature_rows WHERE search_id IS NOT NULL AND candidate_id IS NOT NULL)"
_GOOD = "good AS (SELECT * FROM label_results WHERE candidate_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))"
_GRADES = "grades AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS g)"
_SNAP = f"{_GOOD}, {_GRADES}, snap AS (SELECT label_id, candidate_id, g AS grade FROM good, grades QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY round(abs(score - g), 9), g) = 1)"
_JUDGED = f"""WITH {_ROWS}, {_SNAP}, lab AS (SELECT candidate_id, avg(grade) AS label FROM snap GROUP BY 1),
j AS (SELECT search_id, candidate_id, label, row_number() OVER (PARTITION BY search_id ORDER BY sim_ideal_max DESC NULLS LAST, candidate_id) AS k, row_number() OVER (PARTITION BY search_id ORDER BY label DESC) AS b FROM r JOIN lab USING (candidate_id)),
n AS (SELECT search_id,
  coalesce(sum((pow(2.0::DOUBLE, label) - 1) / log2(k + 1)) FILTER (k <= 10), 0) / nullif(sum((pow(2.0::DOUBLE, label) - 1) / log2(b + 1)) FILTER (b <= 10), 0) AS n10,
  coalesce(sum((pow(2.0::DOUBLE, label) - 1) / log2(k + 1)) FILTER (k <= 50), 0) / nullif(sum((pow(2.0::DOUBLE, label) - 1) / log2(b + 1)) FILTER (b <= 50), 0) AS n50 FROM j GROUP BY 1)"""
_FOLD = "trim(regexp_replace(lower(stratum), '[^a-z0-9]+', '_', 'g'), '_')"


_UNITS = f"WITH u AS (SELECT DISTINCT candidate_id, {_FOLD} AS stratum FROM label_results WHERE candidate_id IS NOT NULL)"


def _quota_sql(quotas: dict[str, int], units: str = _UNITS) -> str:
    parts = [
        f", d{k} AS MATERIALIZED (SELECT candidate_id, stratum FROM u WHERE stratum = '{s}'" + "".join(f" AND candidate_id NOT IN (SELECT candidate_id FROM d{i})" for i in range(k)) + f" ORDER BY md5(candidate_id || '|{s}|42'), candidate_id LIMIT {n})"
        for k, (s, n) in enumerate(quotas.items())
    ]
    return units + "".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(len(quotas)))



QUERIES = {
    "score_distribution": (score_distribution, "SELECT score, count(*) AS n FROM label_results GROUP BY 1"),
    "nearest_grades": (nearest_grades, f"WITH {_SNAP} SELECT label_id, grade FROM snap"),
    "label_agreement": (label_agreement, f"WITH {_GOOD}, h AS (SELECT candidate_id, avg(score) FILTER (run_id % 2 = 1) AS a, avg(score) FILTER (run_id % 2 = 0) AS b FROM good GROUP BY 1) SELECT count(*) AS n, round(corr(a, b), 6) AS r FROM h WHERE a IS NOT NULL AND b IS NOT NULL"),
    "labels_last_delivery": (labels_last_delivery, "SELECT run_id, candidate_id, arg_max(label_id, (coalesce(labelled_at, TIMESTAMP '0001-01-01'), label_id)) AS label_id, count(*) AS n FROM label_results WHERE run_id IS NOT NULL AND candidate_id IS NOT NULL GROUP BY 1, 2"),
    "normalised_scores": (normalised_scores, f"WITH {_ROWS}, s AS (SELECT search_id, candidate_id, CAST(bm25_score AS DOUBLE) AS s, min(CAST(bm25_score AS DOUBLE)) OVER (PARTITION BY search_id) AS lo, max(CAST(bm25_score AS DOUBLE)) OVER (PARTITION BY search_id) AS hi FROM r) SELECT search_id, candidate_id, round(CASE WHEN s IS NULL THEN NULL WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1 END, 6) AS norm FROM s"),
    "final_ranking": (final_ranking, f"WITH {_ROWS}, s AS (SELECT search_id, candidate_id, round(CAST(sim_ideal_max AS DOUBLE), 6) AS score FROM r) SELECT search_id, candidate_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC NULLS LAST, candidate_id) AS INT) AS rank, score FROM s QUALIFY rank <= 100"),
    "ndcg_by_search": (ndcg_by_search, _JUDGED + " SELECT search_id, round(coalesce(n10, 0), 6) AS ndcg_10, round(coalesce(n50, 0), 6) AS ndcg_50 FROM n"),
    "composite_metric": (
        composite_metric,
        _JUDGED + """, c AS (SELECT *, sum(CAST(label >= 0.5 AS INT)) OVER (PARTITION BY search_id ORDER BY k) AS c FROM j),
p AS (SELECT search_id, sum(CAST(label >= 0.5 AS INT)) FILTER (k <= 10) / 10 AS p, coalesce(sum(CASE WHEN label >= 0.5 THEN c / k END) / nullif(sum(CAST(label >= 0.5 AS INT)), 0), 0) AS a FROM c GROUP BY 1)
SELECT search_id, round(p, 6) AS precision_10, round(a, 6) AS average_precision, round(0.5 * coalesce(n10, 0) + 0.3 * coalesce(n50, 0) + 0.15 * a + 0.05 * p, 6) AS composite FROM n JOIN p USING (search_id)""",
    ),
    "score_histogram": (score_histogram, f"WITH {_ROWS}, v AS (SELECT CAST(bm25_score AS DOUBLE) AS v FROM r WHERE bm25_score IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi, CASE WHEN count(*) <= 1 THEN 1 ELSE greatest(4, least(15, floor(count(*) / 7))) END AS b FROM v) SELECT CAST(CASE WHEN hi > lo THEN least(b - 1, floor((v - lo) / (hi - lo) * b)) ELSE 0 END AS INT) AS band, count(*) AS n FROM v, e GROUP BY 1"),
    "measure_summary": (measure_summary, f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{m}' AS measure, count({m}) AS n, round(min(CAST({m} AS DOUBLE)), 4) AS least, round(avg(CAST({m} AS DOUBLE)), 4) AS mean, round(max(CAST({m} AS DOUBLE)), 4) AS most, round(avg(CAST({m} <> 0 AS INT)), 6) AS nonzero FROM r" for m in MEASURES)),
    "ablated_scores": (ablated_scores, f"""WITH {_ROWS}, p AS (SELECT search_id, candidate_id, coalesce(CAST(sim_ideal_max AS DOUBLE), 0) - 0.4 * coalesce(CAST(sim_anti_max AS DOUBLE), 0) AS d,
  coalesce(CAST(skill_evidence_ratio AS DOUBLE), 0) + 0.1 * coalesce(CAST(core_skill_count_evidenced AS DOUBLE), 0) AS s, coalesce(CAST(behavioral_composite AS DOUBLE), 0) + 0.2 * coalesce(CAST(recruiter_response_rate AS DOUBLE), 0) AS b FROM r)
SELECT search_id, candidate_id, round(d + s + b, 4) AS whole, round(d + s + b - d, 4) AS no_dense, round(d + s + b - s, 4) AS no_skills, round(d + s + b - b, 4) AS no_behaviour FROM p"""),
    "quota_sample": (quota_sample, _quota_sql(dict.fromkeys(STRATA, C.QUOTA))),
    "stratified_sample": (stratified_sample, _quota_sql(C.QUOTAS)),
    "split_rows": (split_rows, f"WITH {_GOOD} SELECT candidate_id, CASE WHEN CAST('0x' || substr(md5(candidate_id), 1, 4) AS INT) < 13107 THEN 'validation' ELSE 'training' END AS side FROM (SELECT DISTINCT candidate_id FROM good)"),
    "labelled_and_considered": (labelled_and_considered, "SELECT DISTINCT candidate_id FROM label_results WHERE candidate_id IN (SELECT candidate_id FROM feature_rows)"),
    "labelled_not_considered": (labelled_not_considered, "SELECT DISTINCT candidate_id FROM label_results WHERE candidate_id IS NOT NULL AND candidate_id NOT IN (SELECT candidate_id FROM feature_rows WHERE candidate_id IS NOT NULL)"),
    "all_known_ids": (all_known_ids, "SELECT candidate_id FROM candidates WHERE candidate_id IS NOT NULL UNION SELECT candidate_id FROM label_results WHERE candidate_id IS NOT NULL UNION SELECT candidate_id FROM feature_rows WHERE candidate_id IS NOT NULL"),
    "missing_places": (missing_places, f"WITH {_ROWS}, p AS (SELECT DISTINCT search_id, CAST(rank() OVER (PARTITION BY search_id ORDER BY round(CAST(sim_ideal_max AS DOUBLE), 2) DESC) AS INT) AS p FROM r WHERE sim_ideal_max IS NOT NULL), b AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY search_id ORDER BY p), 0) AS b FROM p) SELECT search_id, CAST(b + 1 AS INT) AS from_place, CAST(p - 1 AS INT) AS to_place FROM b WHERE p > b + 1"),
    "label_batches": (label_batches, "SELECT run_id, CAST(floor((k - 1) / 10) AS INT) AS batch, count(*) AS n FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY label_id) AS k FROM label_results WHERE run_id IS NOT NULL) GROUP BY 1, 2"),
    "ranking_violations": (ranking_violations, None),
    "output_violations": (
        output_violations,
        """WITH s AS (SELECT search_id, candidate_id, coalesce(round(CAST(sim_ideal_max AS DOUBLE), 2), 0) AS score, coalesce(CAST(sim_ideal_max AS DOUBLE), 0) AS s FROM feature_rows WHERE search_id IS NOT NULL),
k AS (SELECT *, lag(score) OVER w AS b, lag(candidate_id) OVER w AS i FROM s WINDOW w AS (PARTITION BY search_id ORDER BY s DESC, candidate_id NULLS FIRST))
SELECT search_id, 'bad_id' AS code, count(*) AS n FROM k WHERE candidate_id IS NULL OR NOT regexp_matches(candidate_id, '^CAND_[0-9]{7}$') GROUP BY 1
UNION ALL SELECT search_id, 'rising', count(*) FROM k WHERE score > b GROUP BY 1
UNION ALL SELECT search_id, 'tie_order', count(*) FROM k WHERE score = b AND candidate_id < i GROUP BY 1
UNION ALL SELECT search_id, 'repeated_id', count(*) FROM (SELECT search_id, candidate_id FROM s GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""",
    ),
}
