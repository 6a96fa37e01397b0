"""p6: one ranking from several scores on unlike scales, by robust rank aggregation.

Each score is replaced by the share of the group's items that are at least as good, so scale, spread and
extreme values are gone. An item's shares are sorted; were the scores unrelated to its worth, the k-th
smallest of m would follow a Beta(k, m - k + 1) distribution. The smallest of those m probabilities, times
m, says how surprising the item's ranks are; items are ranked by it.

Shares are counted without gathering a group: equal scores are counted first, counts are summed within
slices of the score's range, and slices are added up. A group that holds most rows is spread over slices.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions.tables import table
from quillrank.operators.ranking import upper_shares

SCORES = ["bm25_score", "sim_ideal_max", "behavioral_composite"]
TOP = 10


def order_statistic_probability(x: Column, k: int, m: int) -> Column:
    """P(the k-th smallest of m uniform values is at most x): the Beta(k, m - k + 1) distribution function."""
    terms = [F.lit(float(comb(m, j))) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(m - j)) for j in range(k, m + 1)]
    return reduce(lambda a, b: a + b, terms)


def robust_rank(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """(group, item, rho, p_value, mean_share) of each distinct item; larger scores are better.

    An item given twice counts once, with its best value of each score. Rows with a null group or item are
    left out. An empty table gives an empty one.
    """
    m = len(scores)
    items = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*(F.max(F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double"))).alias(s) for s in scores))
    long = items.select(group, item, F.posexplode(F.array(*scores)).alias("_which", "_score"))
    shares = upper_shares(long, [group, "_which"], item, "_score")
    sorted_ = shares.groupBy(group, item).agg(F.array_sort(F.collect_list("share")).alias("_r"))
    p = F.least(*(order_statistic_probability(F.col("_r")[k - 1], k, m) for k in range(1, m + 1))) if m > 1 else F.col("_r")[0]
    mean = F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / m
    return sorted_.select(group, item, p.alias("rho"), F.least(p * m, F.lit(1.0)).alias("p_value"), mean.alias("mean_share"))


def top_items(ranked: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The first ``n`` of each group; each task keeps only its own first ``n`` before the shuffle."""
    w = W.partitionBy(group).orderBy(F.round("rho", 12), F.round("mean_share", 12), item)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = robust_rank(table(spark, sf_dir, "feature_rows"), "search_id", "candidate_id", SCORES)
    return top_items(ranked, "search_id", "candidate_id", TOP).select("search_id", "candidate_id")


def p6_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every search with its significance, the order of the whole search."""
    ranked = robust_rank(table(spark, sf_dir, "feature_rows"), "search_id", "candidate_id", SCORES)
    return ranked.select("search_id", "candidate_id", F.round("rho", 9).alias("rho"), F.round("p_value", 9).alias("p_value"), F.round("mean_share", 9).alias("mean_share"))


_RRA_SQL = """
WITH items AS (
  SELECT search_id, candidate_id, max(CAST(bm25_score AS DOUBLE)) AS a, max(CAST(sim_ideal_max AS DOUBLE)) AS b, max(CAST(behavioral_composite AS DOUBLE)) AS c
  FROM feature_rows WHERE search_id IS NOT NULL AND candidate_id IS NOT NULL GROUP BY 1, 2),
shares AS (
  SELECT search_id, candidate_id,
    CASE WHEN a IS NULL THEN 1.0::DOUBLE ELSE cume_dist() OVER (PARTITION BY search_id ORDER BY a DESC NULLS LAST) END AS a,
    CASE WHEN b IS NULL THEN 1.0::DOUBLE ELSE cume_dist() OVER (PARTITION BY search_id ORDER BY b DESC NULLS LAST) END AS b,
    CASE WHEN c IS NULL THEN 1.0::DOUBLE ELSE cume_dist() OVER (PARTITION BY search_id ORDER BY c DESC NULLS LAST) END AS c
  FROM items),
ordered AS (
  SELECT search_id, candidate_id, least(a, b, c) AS x, a + b + c - least(a, b, c) - greatest(a, b, c) AS y, greatest(a, b, c) AS z, (a + b + c) / 3 AS mean_share FROM shares),
scored AS (
  SELECT search_id, candidate_id, mean_share, least(1 - pow(1 - x, 3), 3 * y * y - 2 * pow(y, 3), pow(z, 3)) AS rho FROM ordered)
"""
P6_FOUND_SQL = _RRA_SQL + """
SELECT search_id, candidate_id FROM scored
QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY round(rho, 12), round(mean_share, 12), candidate_id) <= 10
"""
P6_SIGNIFICANCE_SQL = _RRA_SQL + """
SELECT search_id, candidate_id, round(rho, 9) AS rho, round(least(3 * rho, 1.0::DOUBLE), 9) AS p_value, round(mean_share, 9) AS mean_share FROM scored
"""
