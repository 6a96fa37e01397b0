"""Boosted trees: training, scoring, and exact additive contributions of features.

Training and scoring are the library's. Contributions come from a table of nodes: the trained trees are
exported once (their size is bounded by depth and rounds), and a vectorised function walks each row's weighted
paths, so that contributions and the base value sum to the prediction.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tables import checkpoint
from quillrank.operators import metrics

#: Fixed values of the training run.
DEPTH, STEP, MIN_ROWS, SUBSAMPLE, COLUMNS, SEED = 6, 0.05, 5, 0.8, "0.8", 42
#: Rounds without a smaller error on the held-out rows that end the growing.
PATIENCE = 30


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=features, outputCol="_x").transform(filled)


def train(df: DataFrame, features: list[str], label: str, rounds: int = 40, validation: str | None = None, patience: int = PATIENCE) -> GBTRegressionModel:
    """Squared-error boosted trees; missing features are 0.

    ``validation`` is a boolean column: no tree sees rows where it is true, and growing ends after ``patience``
    rounds without a smaller squared error on them. As in the reference the trees of these rounds stay in the
    model. Without such rows all rounds are grown. The library's own rule has no patience, so a fit of 1/8 of
    the rounds is doubled until it is long enough to hold the end; a longer fit begins with the same trees.
    """
    trainer = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=MIN_ROWS, subsamplingRate=SUBSAMPLE, featureSubsetStrategy=COLUMNS, seed=SEED)
    rows = _assembled(df, features)
    if not validation:
        return trainer.fit(rows)
    grown, held = rows.where(~F.col(validation)), rows.where(F.col(validation))
    if held.isEmpty():
        return trainer.fit(grown)
    n = min(rounds, max(2 * patience, rounds // 8))
    while True:
        fitted = trainer.setMaxIter(n).fit(grown)
        end = last_round(fitted.evaluateEachIteration(held, "squared"), patience)
        if end or n == rounds:
            return first_trees(fitted, end or n)
        n = min(rounds, 2 * n)


def last_round(errors: list[float], patience: int) -> int | None:
    """The round, from 1, after which ``patience`` rounds in a row had no error below the least before; None if none."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            return k + 1
    return None


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    if n >= model.getNumTrees:
        return model
    java = model._java_obj
    kept = SparkContext._jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), java.trees()[:n], java.treeWeights()[:n], java.numFeatures())
    return model._copyValues(GBTRegressionModel(kept))


def predict(model: GBTRegressionModel, df: DataFrame, features: list[str], out: str = "score") -> DataFrame:
    return model.setPredictionCol(out).transform(_assembled(df, features)).drop("_x")


def importances(model: GBTRegressionModel, features: list[str], k: int = 15) -> list[tuple[str, float]]:
    gains = sorted(zip(features, model.featureImportances.toArray()), key=lambda x: (-x[1], x[0]))
    return [(f, float(g)) for f, g in gains[:k]]


def save(model: GBTRegressionModel, features: list[str], path: str) -> None:
    """The model and the names of its features, in their order."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(features),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/features")


def load(path: str) -> tuple[GBTRegressionModel, list[str]]:
    return GBTRegressionModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/features").head()[0])


def ablations(df: DataFrame, features: list[str], label: str, without: dict[str, list[str]], rounds: int, validation: str) -> DataFrame:
    """(mode, rounds, rmse, ndcg_10, ndcg_50): a model trained anew for the whole and for each set of features put to
    zero, judged on the rows of ``validation``, which are one ranking."""
    key = F.monotonically_increasing_id()
    out = []
    for mode, gone in {"full": [], **without}.items():
        cut = df.withColumns({f: F.lit(0.0) for f in gone})
        fitted = train(cut, features, label, rounds, validation)
        held = checkpoint(predict(fitted, cut.where(F.col(validation)), features, "_score").select(F.col("_score").alias("guess"), F.col(label).cast("double").alias("truth"), F.lit(0).alias("ranking"), key.alias("row_no")))
        by = [F.desc("guess"), F.col("row_no")]
        at = {k: metrics.ndcg(held, "ranking", by, "truth", k).head() for k in (10, 50)}
        rmse = held.agg(F.sqrt(F.avg(F.pow(F.col("guess") - F.col("truth"), 2))).alias("e")).head()["e"]
        out.append((mode, fitted.getNumTrees, rmse, *(at[k]["ndcg"] if at[k] else None for k in (10, 50))))
    return df.sparkSession.createDataFrame(out, "mode string, rounds int, rmse double, ndcg_10 double, ndcg_50 double")


def nodes(model: GBTRegressionModel) -> list[dict]:
    """Per tree its weight and arrays: feature (-1 at a leaf), threshold, left, right, value, cover."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        t: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

        def visit(node, t=t) -> int:
            at = len(t["feature"])
            leaf = node.subtreeDepth() == 0
            for k, v in (("feature", -1 if leaf else node.split().featureIndex()), ("threshold", 0.0 if leaf else node.split().threshold()), ("left", -1), ("right", -1), ("value", node.prediction()), ("cover", float(node.impurityStats().count()))):
                t[k].append(v)
            if not leaf:
                t["left"][at] = visit(node.leftChild())
                t["right"][at] = visit(node.rightChild())
            return at

        visit(tree._call_java("rootNode"))
        out.append({"weight": float(weight), **{k: np.array(v) for k, v in t.items()}})
    return out


def _leaf_paths(t: dict) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Of each leaf: value and, for each feature on its path, (feature, low, high, share of cover kept)."""
    found = []

    def go(at: int, path: dict[int, tuple[float, float, float]]) -> None:
        f = int(t["feature"][at])
        if f < 0:
            found.append((float(t["value"][at]), [(k, *v) for k, v in path.items()]))
            return
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((int(t["left"][at]), (low, min(high, t["threshold"][at]))), (int(t["right"][at]), (max(low, t["threshold"][at]), high))):
            go(child, path | {f: (*bounds, share * t["cover"][child] / t["cover"][at])})

    go(0, {})
    return found


def tree_contributions(x: np.ndarray, trees: list[dict]) -> tuple[np.ndarray, float]:
    """Shapley values (rows, features) of path-dependent trees and their base value.

    For a leaf with features S on its path a coalition keeps the leaf's value times 1 or 0 for each feature it
    knows and the share of cover for each it does not; the weight of every size of coalition comes from the
    coefficients of a product of linear terms, one a feature.
    """
    out, base = np.zeros(x.shape), 0.0
    for t in trees:
        for value, path in _leaf_paths(t):
            value *= t["weight"]
            base += value * float(np.prod([p[3] for p in path]))
            d = len(path)
            if not d:
                continue
            inside = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in path]
            for k, (f, _, _, share) in enumerate(path):
                # poly[s]: sum over coalitions of s other features of what they let through.
                poly = np.zeros((d, len(x)))
                poly[0] = 1.0
                size = 0
                for j in range(d):
                    if j == k:
                        continue
                    size += 1
                    poly[1 : size + 1] = poly[1 : size + 1] * path[j][3] + poly[:size] * inside[j]
                    poly[0] *= path[j][3]
                weight = _weights(d)
                out[:, f] += value * (inside[k] - share) * (weight[:, None] * poly).sum(axis=0)
    return out, base


def _weights(d: int) -> np.ndarray:
    w = np.ones(d)
    w[0] = 1.0 / d
    for s in range(1, d):
        w[s] = w[s - 1] * s / (d - s)
    return w


def contributions(model: GBTRegressionModel, df: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, bias, contributions array<double> in the order of ``features``) of each row."""
    trees = nodes(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            values, base = tree_contributions(np.nan_to_num(x), trees)
            yield pd.DataFrame({key: pdf[key], "bias": base, "contributions": list(values)})

    return df.select(key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features)).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, bias double, contributions array<double>")


def most_negative(contributions_col, features: list[str], k: int = 2, below: float = -0.005):
    """array<struct<value, feature>> of the k features that lower a row's score most, if below a bound."""
    named = F.arrays_zip(contributions_col.alias("value"), F.array(*map(F.lit, features)).alias("feature"))
    return F.slice(F.array_sort(F.filter(named, lambda e: e["value"] < below)), 1, k)
