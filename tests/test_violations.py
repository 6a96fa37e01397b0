"""Output checks over a ranking table."""

from quillrank.operators import ranking


def found(spark, rows, n):
    df = spark.createDataFrame([("a", *r) for r in rows], "g string, candidate_id string, rank string, score string")
    return {r["code"]: r["n"] for r in ranking.violations(df, "g", n).collect()}


def test_a_ranking_with_a_missing_rank_is_not_clean(spark):
    c = "CAND_000000"
    assert found(spark, [(c + "1", "1", "0.9"), (c + "2", "2", "0.9"), (c + "3", "3", "0.1")], 3) == {}
    assert found(spark, [(c + "1", "1", "0.9"), (c + "3", "3", "0.1")], 3) == {"missing_rank": 1, "row_count": 1}
    assert found(spark, [(c + "1", "1", "0.9"), (c + "2", "1", "0.8"), (c + "2", "4", "x"), ("no", "02", "0.1")], 4) == {"bad_id": 1, "repeated_id": 1, "bad_rank": 1, "repeated_rank": 1, "missing_rank": 2, "bad_score": 1}
    assert found(spark, [(c + "2", "1", "0.5"), (c + "1", "2", "0.5"), (c + "3", "9", "0.7")], 3) == {"rank_range": 1, "missing_rank": 1, "rising": 1, "tie_order": 1}
