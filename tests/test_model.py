import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from quillrank.operators import model
from quillrank.plans.scoring import FEATURES, ROUNDS, model_contributions, trained


def coalition(tree, x, known, at=0):
    f = int(tree["feature"][at])
    if f < 0:
        return tree["value"][at]
    left, right = int(tree["left"][at]), int(tree["right"][at])
    if f in known:
        return coalition(tree, x, known, left if x[f] <= tree["threshold"][at] else right)
    return sum(tree["cover"][c] / tree["cover"][at] * coalition(tree, x, known, c) for c in (left, right))


def test_contributions_are_shapley_values_and_sum_to_the_score(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, 4))
    y = 2 * x[:, 0] - x[:, 1] * (x[:, 2] > 0.5) + 0.1 * rng.random(300)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, d double, y double")
    names = ["a", "b", "c", "d"]
    fitted = model.train(df, names, "y", rounds=4)
    score = {r["i"]: r["score"] for r in model.predict(fitted, df, names).collect()}
    parts = {r["i"]: r for r in model.contributions(fitted, df, names, "i").collect()}
    assert all(abs(parts[i]["bias"] + sum(parts[i]["contributions"]) - score[i]) < 1e-9 for i in score)
    trees = model.nodes(fitted)
    for i in (0, 7):
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = 0.0
            for n in range(4):
                for s in itertools.combinations(rest, n):
                    w = math.factorial(n) * math.factorial(3 - n) / math.factorial(4)
                    want += w * sum(t["weight"] * (coalition(t, x[i], {*s, f}) - coalition(t, x[i], set(s))) for t in trees)
            assert abs(want - parts[i]["contributions"][f]) < 1e-9
    assert model.importances(fitted, names)[0][0] == "a"


def test_contributions_on_the_table(spark):
    out = model_contributions(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where(F.size("contributions") != len(FEATURES)).count() == 0


def test_growing_ends_by_the_held_out_error(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 2))
    y = x[:, 0] + rng.normal(0, 0.3, 400)
    df = spark.createDataFrame([(i, *map(float, r), float(v), i % 5 == 0) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, y double, held boolean").coalesce(1).cache()
    fitted = model.train(df, ["a", "b"], "y", 80, "held", patience=5)
    held, grown = df.where("held"), df.where("not held")
    whole = model.train(grown, ["a", "b"], "y", 80)
    errors = whole.evaluateEachIteration(model._assembled(held, ["a", "b"]), "squared")
    n = model.last_round(errors, 5)
    assert n < 80 and fitted.getNumTrees == n and min(errors[:n]) == errors[n - 6]
    for a, b in zip(model.nodes(fitted), model.nodes(whole)):
        assert all(np.array_equal(a[k], b[k]) for k in a)
    assert model.predict(fitted, df, ["a", "b"]).where("score is not null").count() == 400
    assert model.last_round([3.0, 2.0, 2.0, 1.0], 2) is None and model.last_round([3.0, 2.0, 2.0, 2.5, 1.0], 2) == 4


def test_the_model_takes_every_column_of_a_feature_row(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/feature_rows.parquet")
    assert [c for c in table.columns if c not in ("search_id", "candidate_id")] == FEATURES and len(FEATURES) == 48
    fitted = trained(spark, "/root/testdata/sf0.001")
    assert fitted.numFeatures == 48 and model.PATIENCE < fitted.getNumTrees <= ROUNDS
