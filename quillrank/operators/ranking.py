"""Ranks, fusion, normalisation and top-k.

A row number over a whole table goes through one task, so ranks are only numbered after a top-k, which each
task cuts for itself; shares over a whole table come from counts per value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions.config import RRF_K


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows with ``rank`` from 1; only they reach the one task that numbers them."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fuse(rankings: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, rrf): sum over the rankings of 1 / (k + rank), ranks from 1."""
    parts = [r.select(key, (F.lit(1.0) / (k + F.col("rank"))).alias("_s")) for r in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("_s").alias("rrf"))


def reranked(df: DataFrame, group: list[str], key: str, score: str, head: int, rescored: str | None = None) -> DataFrame:
    """``df`` with ``order_score`` and ``place``: the first ``head`` rows of each group are ordered anew, the rest follow.

    ``rescored`` is a column with the reranker's score; where it is null for any of a group's head, or there is no
    reranker, the whole head keeps its order and scores ``head`` down to 1. The rest keeps its own score. Ties
    go to the smaller key; null scores come last.
    """
    before = W.partitionBy(*group).orderBy(F.desc_nulls_last(score), key)
    ranked = df.withColumn("_k", F.row_number().over(before)).withColumn("_head", F.col("_k") <= head)
    fallback = (F.lit(head) - F.col("_k") + 1).cast("double")
    if rescored is not None:
        failed = F.max(F.when(F.col("_head"), F.col(rescored).isNull())).over(W.partitionBy(*group))
        fallback = F.when(failed, fallback).otherwise(F.col(rescored))
    ranked = ranked.withColumn("order_score", F.when(F.col("_head"), fallback).otherwise(F.col(score)))
    after = W.partitionBy(*group).orderBy(F.desc("_head"), F.desc_nulls_last("order_score"), key)
    return ranked.withColumn("place", F.row_number().over(after)).drop("_k", "_head")


def _slice(score: Column) -> Column:
    """A number that grows with the score, of about 64 steps for each doubling."""
    size = F.when(F.abs(score) < 1e-300, F.lit(0.0)).otherwise((F.log2(F.abs(score)) + 1000) * 64)
    return F.floor(F.when(score < 0, -size).otherwise(size))


#: Rows of one value of a group that meet in one task, and how many such values are cut into parts at most (their
#: list is broadcast; any further ones are left to the planner's skew handling).
TIED_ROWS, MAX_TIED = 100_000, 10_000


def upper_shares(df: DataFrame, group: list[str], item: str, score: str) -> DataFrame:
    """``group``, ``item`` and ``share``: of the group's items, the part that scores at least as high.

    Equal scores are counted first, counts are summed within slices of the score's range, slices are added
    up: no task holds a group, and a group that holds most rows is spread over its slices. Rows find their value
    by a join; a value of very many rows is cut into parts, and rows without a score, which match nothing, are
    spread. Null and NaN scores are worst and share 1. Ties share one value.
    """
    scored = F.col(score).isNotNull() & ~F.isnan(F.col(score))
    counts = df.where(scored).groupBy(*group, score).agg(F.count(F.lit(1)).alias("_n")).withColumn("_slice", _slice(F.col(score)))
    slices = counts.groupBy(*group, "_slice").agg(F.sum("_n").alias("_in"))
    above = W.partitionBy(*group).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(*group, "_slice", F.coalesce(F.sum("_in").over(above), F.lit(0)).alias("_above"))
    within = W.partitionBy(*group, "_slice").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("_run", F.sum("_n").over(within)).join(slices, [*group, "_slice"])
    part = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / TIED_ROWS).cast("int") - 1))
    ranked = ranked.select(*group, score, (F.col("_above") + F.col("_run")).alias("_rank"), part.alias("_part"))
    tied = counts.where(F.col("_n") > TIED_ROWS).orderBy(F.desc("_n")).limit(MAX_TIED).select(*group, score, F.ceil(F.col("_n") / TIED_ROWS).cast("int").alias("_parts"))
    rows = df.join(F.broadcast(tied), [*group, score], "left")
    spread = F.pmod(F.xxhash64(item), F.coalesce("_parts", F.when(scored, 1).otherwise(1 << 16))).cast("int")
    rows = rows.select(*group, item, score, spread.alias("_part"))
    joined = rows.join(ranked, [*group, score, "_part"], "left")
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    return joined.join(totals, group).select(*group, item, F.coalesce(F.col("_rank") / F.col("_all"), F.lit(1.0)).alias("share"))


def share_at_most(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, share): the share of all rows whose score, to nine places, is at most the row's own."""
    turned = df.select(key, F.lit(0).alias("_all_rows"), F.round(-F.col(score), 9).alias("_s"))
    return upper_shares(turned, ["_all_rows"], key, "_s").select(key, "share")


def min_max(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """``norm``: the score from 0 to 1 within its group; 1 where all are equal."""
    ends = df.groupBy(*group).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    flat = F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    return df.join(ends, group).withColumn("norm", F.when(F.col(score).isNotNull(), flat)).drop("_lo", "_hi")


def violations(df: DataFrame, group: str, rows: int = 100) -> DataFrame:
    """(group, code, n): what is wrong with rankings given as candidate_id, rank and score, as text or typed.

    Codes: bad_id, repeated_id, bad_rank (no canonical whole number), rank_range, repeated_rank, missing_rank (of
    1 to ``rows``), row_count, bad_score, rising (score above the one before), tie_order (equal scores, ids not
    ascending). Equal ranks go by id. A ranking without any row has no group to report.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    number = r"^(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"
    t = df.select(group, text("candidate_id").alias("_id"), text("rank").alias("_rank"), text("score").alias("_score"))
    t = t.withColumns({"_id_ok": F.col("_id").rlike("^CAND_[0-9]{7}$"), "_r": F.when(F.col("_rank").rlike(r"^(0|-?[1-9]\d*)$"), F.expr("try_cast(_rank as decimal(38,0))")), "_s": F.when(F.col("_score").rlike(number), F.expr("try_cast(_score as double)"))})
    inside = F.col("_r").between(1, rows)
    hit = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    ids, ranks = F.count(F.when(F.col("_id_ok"), 1)), F.count(F.when(inside, 1))
    n_ids, n_ranks = F.count_distinct(F.when(F.col("_id_ok"), F.col("_id"))), F.count_distinct(F.when(inside, F.col("_r")))
    counts = {
        "bad_id": F.sum(hit(~F.col("_id_ok"))), "repeated_id": ids - n_ids, "bad_rank": F.sum(hit(F.col("_r").isNull())), "rank_range": F.sum(hit(~inside)), "repeated_rank": ranks - n_ranks,
        "missing_rank": rows - n_ranks, "row_count": (F.count(F.lit(1)) != rows).cast("bigint"), "bad_score": F.sum(hit(F.col("_s").isNull())),
    }
    w = W.partitionBy(group).orderBy("_r", "_id")
    pairs = t.where((F.col("_id") != "") & F.col("_r").isNotNull() & F.col("_s").isNotNull()).withColumns({"_before": F.lag("_s").over(w), "_above": F.lag("_id").over(w)})
    plain = ~F.isnan("_s") & ~F.isnan("_before")
    order = {"rising": F.sum(hit(plain & (F.col("_s") > F.col("_before")))), "tie_order": F.sum(hit(plain & (F.col("_s") == F.col("_before")) & (F.col("_id") < F.col("_above"))))}

    def long(x: DataFrame, codes: dict[str, Column]) -> DataFrame:
        every = F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).cast("bigint").alias("n")) for c in codes))
        return x.groupBy(group).agg(*(v.alias(c) for c, v in codes.items())).select(group, F.inline(every)).where("n > 0")

    return long(t, counts).unionByName(long(pairs, order))
