"""Dense vectors: products, cosines and pooled maxima without leaving the JVM; nearest rows of many queries in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions.tables import checkpoint

NORM_EPSILON = 1e-9
#: Rows scored at once, and what a score may be below the last kept, as rounding and ties are settled at the end.
SLICE, SLACK = 2048, 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a)) + NORM_EPSILON


def cosines(vectors: DataFrame, queries: DataFrame, key: str, vec: str, qid: str) -> DataFrame:
    """(key, cosines array<struct<qid, cos>>) of all vectors against a few stated queries, without a shuffle.

    The queries become one array column, so every vector meets them in its own row; they have to be few
    (checked) as they travel with the plan. ``nearest`` takes any number of them.
    """
    rows = queries.select(qid, vec).orderBy(qid).limit(257).collect()
    if len(rows) > 256:
        raise ValueError("more than 256 query vectors; nearest() scores them in blocks")
    unit = []
    for r in rows:
        size = sum(float(x) ** 2 for x in r[vec]) ** 0.5 + NORM_EPSILON
        unit.append((r[qid], [float(x) / size for x in r[vec]]))
    own = vectors.select(key, F.col(vec).cast("array<double>").alias("_v"), norm(F.col(vec)).alias("_n"))
    every = F.array(*(F.struct(F.lit(q).alias(qid), (dot(F.col("_v"), F.array(*map(F.lit, v))) / F.col("_n")).alias("cos")) for q, v in unit))
    return own.select(key, every.alias("cosines"))


def _kept(q: np.ndarray, ids: np.ndarray, s: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of scored pairs those among the k best of their query, or as good; and each query's least score to enter."""
    if not len(s):
        return q, ids, s, np.full(n, -np.inf)
    order = np.lexsort((-s, q))
    q, ids, s = q[order], ids[order], s[order]
    ends = np.searchsorted(q, np.arange(n), side="right")
    last = np.searchsorted(q, np.arange(n)) + k - 1
    floor = np.where(last < ends, s[np.minimum(last, len(s) - 1)] - SLACK, -np.inf)
    good = s >= floor[q]
    return q[good], ids[good], s[good], floor


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vec: str, qid: str, k: int, block: int = 1024) -> DataFrame:
    """(qid, key, score, rank): of each query the k rows of greatest cosine to nine places, ties to the smaller key.

    Any number of queries: a block of them at a time passes through the driver and meets all rows in slices,
    each task keeps k rows a query, and what is left of a block is written before the next is read.
    """
    rows = vectors.where(F.col(vec).isNotNull()).select(key, vec)
    waiting = queries.where(F.col(vec).isNotNull()).select(qid, vec).orderBy(qid).toLocalIterator()
    kinds = dict(queries.dtypes)[qid], dict(vectors.dtypes)[key]
    schema, found = f"`{qid}` {kinds[0]}, `{key}` {kinds[1]}, cos double", []

    def scorer(names: np.ndarray, unit: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, ids, s, floor = np.array([], int), None, np.array([]), np.full(len(names), -np.inf)
            for pdf in batches:
                for at in range(0, len(pdf), SLICE):
                    part = pdf.iloc[at : at + SLICE]
                    x, own = np.stack(part[vec].to_numpy()).astype(float), part[key].to_numpy()
                    cos = (x @ unit.T) / (np.sqrt((x * x).sum(axis=1)) + NORM_EPSILON)[:, None]
                    i, j = np.nonzero(cos >= floor)
                    q, ids, s, floor = _kept(np.concatenate([q, j]), own[i] if ids is None else np.concatenate([ids, own[i]]), np.concatenate([s, cos[i, j]]), len(names), k)
            if ids is not None:
                yield pd.DataFrame({qid: names[q], key: ids, "cos": s})

        return run

    first = W.partitionBy(qid).orderBy(F.desc("score"), key)
    while some := list(islice(waiting, block)):
        v = np.array([r[vec] for r in some], float)
        unit = v / (np.sqrt((v * v).sum(axis=1)) + NORM_EPSILON)[:, None]
        scored = rows.mapInPandas(scorer(np.array([r[qid] for r in some]), unit), schema).select(qid, key, F.round("cos", 9).alias("score"))
        found.append(checkpoint(scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)))
    empty = vectors.sparkSession.createDataFrame([], f"`{qid}` {kinds[0]}, `{key}` {kinds[1]}, score double, rank int")
    return reduce(DataFrame.unionByName, found or [empty])


def mean_pool(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, mean array<double>) of the vectors of each key; null vectors do not count.

    Vectors are summed within Arrow batches before the shuffle, so a key on most rows arrives as few rows.
    """
    kind = dict(vectors.dtypes)[key]
    empty = "array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, names = pd.factorize(pdf[key], use_na_sentinel=False)
            x = np.stack(pdf[vec].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
            sums = np.zeros((len(names), x.shape[1]))
            np.add.at(sums, codes, x)
            yield pd.DataFrame({key: names, "_sum": list(sums), "_n": np.bincount(codes, minlength=len(names))})

    parts = vectors.where(F.col(vec).isNotNull()).select(key, vec).mapInPandas(partial, f"`{key}` {kind}, _sum {empty}, _n bigint")
    places = parts.select(key, "_n", F.posexplode("_sum").alias("_at", "_x")).groupBy(key, "_at").agg((F.sum("_x") / F.sum("_n")).alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_m")))
    return places.groupBy(key).agg(F.transform(ordered, lambda e: e["_m"]).alias("mean"))


def cosine_product_epsilon(a: Column, b: Column, epsilon: float = 1e-8) -> Column:
    """The second form of the cosine: the small number is added to the product of the lengths, not to each."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon)
