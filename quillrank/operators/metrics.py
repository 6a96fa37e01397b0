"""Ranking metrics, histograms and agreement, as relational aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ndcg(df: DataFrame, group: str, order: list, gain: str, k: int) -> DataFrame:
    """(group, ndcg) at k with gain 2**y - 1 and a log2 discount; 0 where no item has gain.

    Only the first k of each order are kept per task before the shuffle.
    """
    def first_k(*by):
        r = F.row_number().over(W.partitionBy(group).orderBy(*by))
        return df.withColumn("_r", r).where(F.col("_r") <= k).groupBy(group).agg(F.sum((F.pow(F.lit(2.0), F.coalesce(F.col(gain), F.lit(0.0))) - 1) / F.log2(F.col("_r") + 1.0)).alias("_g"))

    got, best = first_k(*order), first_k(F.desc_nulls_last(gain))
    return got.withColumnRenamed("_g", "_got").join(best, group).select(group, F.when(F.col("_g") > 0, F.col("_got") / F.col("_g")).otherwise(0.0).alias("ndcg"))


def precision_and_map(df: DataFrame, group: str, order: list, relevant, k: int) -> DataFrame:
    """(group, precision, average_precision): share relevant among the first k; mean precision at relevant ranks."""
    w = W.partitionBy(group).orderBy(*order)
    hit = df.withColumn("_r", F.row_number().over(w)).withColumn("_h", F.coalesce(relevant.cast("int"), F.lit(0)))
    run = hit.withColumn("_c", F.sum("_h").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = run.groupBy(group).agg(F.sum(F.when(F.col("_r") <= k, F.col("_h"))).alias("_p"), F.sum(F.col("_h") * F.col("_c") / F.col("_r")).alias("_a"), F.sum("_h").alias("_n"))
    return out.select(group, (F.col("_p") / k).alias("precision"), F.when(F.col("_n") > 0, F.col("_a") / F.col("_n")).otherwise(0.0).alias("average_precision"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(band, n): n // 7 bands, from 4 to 15, of equal width; the greatest value is in the last one."""
    ends = df.where(F.col(value).isNotNull()).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    ends = ends.withColumn("_b", F.when(F.col("_n") <= 1, 1).otherwise(F.greatest(F.lit(4), F.least(F.lit(15), F.floor(F.col("_n") / 7)))))
    j = df.where(F.col(value).isNotNull()).join(F.broadcast(ends))
    band = F.when(F.col("_hi") > F.col("_lo"), F.least(F.col("_b") - 1, F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_b")))).otherwise(0)
    return j.groupBy(band.cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def nearest_grade(x, grades: list[float]):
    """The grade nearest to a value, the lower of two equally near; null for null."""
    near = F.array_min(F.array(*(F.struct(F.round(F.abs(x - g), 9).alias("d"), F.lit(g).alias("g")) for g in grades)))
    return F.when(x.isNotNull(), near["g"])
