"""Files in their several forms, kept models and indexes, checks of written rankings."""

import pytest
from pyspark.sql import functions as F

from quillrank.operators import bm25, model
from quillrank.sources import readers, validation, writers


def test_a_folder_of_lines_and_lists(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"candidate_id":"CAND_0000001"}\n\n{"candidate_id":"CAND_0000002"}\n')
    (tmp_path / "b.json").write_text('\n[{"candidate_id":"CAND_0000003"},\n{"candidate_id":"CAND_0000004"}]')
    got = sorted(r[0] for r in readers.read_candidates(spark, str(tmp_path)).select("candidate_id").collect())
    assert got == [f"CAND_000000{k}" for k in (1, 2, 3, 4)]
    assert readers.read_candidate_list(spark, str(tmp_path / "b.json")).count() == 2
    with pytest.raises(ValueError):
        readers.read_candidate_list(spark, str(tmp_path / "a.jsonl"))


def test_last_delivery_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z")], "k string, at int, v string")
    assert [tuple(r) for r in readers.last_wins(df, "k", ["at"]).select("k", "at", "v").collect()] == [("a", 2, None)]


def test_missing_artifacts_and_texts(spark, tmp_path):
    assert readers.read_artifact(spark, str(tmp_path / "none"), "id bigint, v array<double>").count() == 0
    assert readers.read_text(spark, str(tmp_path / "none"), "fallback") == "fallback"
    (tmp_path / "role.txt").write_text("line one\nline two")
    assert readers.read_text(spark, str(tmp_path / "role.txt")) == "line one\nline two"


def _ranking(spark, n=100):
    return spark.range(n).select(F.format_string("CAND_%07d", "id").alias("candidate_id"), (F.col("id") + 1).cast("int").alias("rank"), (1 - F.col("id") / 1000).alias("score"), F.when(F.col("id") % 2 == 0, "it, \"quoted\"").otherwise("plain").alias("reasoning"))


def test_written_rankings_pass_and_broken_ones_do_not(spark, tmp_path):
    lines = ["candidate_id,rank,score,reasoning", *(r["line"] for r in writers.ranking_lines(_ranking(spark)).orderBy("rank").collect())]
    assert lines[1].startswith("CAND_0000000,1,1.000000,") and len(writers.ranking_lines(_ranking(spark), 10).collect()) == 10
    assert writers.id_lines(_ranking(spark, 3)).count() == 3
    (tmp_path / "good.csv").write_text("\n".join(lines) + "\n\n")
    assert validation.file_violations(spark, str(tmp_path / "good.csv")).collect() == []
    broken = ["rank,candidate_id,score,reasoning", *lines[1:50], "CAND_1,051,x,why", lines[51], *lines[51:100], "CAND_0000200,100,0.5,a,b"]
    (tmp_path / "bad.txt").write_text("\n".join(broken))
    codes = {r["code"]: r["n"] for r in validation.file_violations(spark, str(tmp_path / "bad.txt")).collect()}
    assert {"suffix": 1, "header": 1, "cells": 1, "bad_id": 1, "repeated_id": 1, "bad_rank": 1, "bad_score": 1, "repeated_rank": 1, "row_count": 1}.items() <= codes.items()
    (tmp_path / "bytes.csv").write_bytes(b"\xff\xfe\x00")
    assert {r["code"] for r in validation.file_violations(spark, str(tmp_path / "bytes.csv")).collect()} >= {"encoding", "header"}
    (tmp_path / "finalists.csv").write_text("candidate_id,rank\nCAND_0000001,1\n ,\nCAND_0000002,x\n")
    assert [tuple(r) for r in readers.read_finalists(spark, str(tmp_path / "finalists.csv")).collect()] == [("CAND_0000001", 1), ("CAND_0000002", None)]


def test_index_is_attached_by_version_and_scores_alike(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "red"), (3, None), (4, ""), (5, "one fish two")], "doc_id bigint, text string")
    path = str(tmp_path / "index")
    assert bm25.attach_index(spark, path) is None
    index = bm25.index_of(docs, "doc_id", "text", path, "v1")
    assert bm25.attach_index(spark, path, "v2") is None and bm25.attach_index(spark, path, "v1").stats.n == 5
    for query in ("Red fish, fish!", "nothing known", ""):
        want = {r[0]: round(r[1], 9) for r in bm25.scores(docs, "doc_id", "text", query).collect()}
        assert {r[0]: round(r[1], 9) for r in index.scores(query).collect()} == want and len(want) == 5
    plan = index.scores("red")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan
    empty = docs.limit(0)
    assert bm25.scores(empty, "doc_id", "text", "red").count() == 0


def test_models_are_kept_and_ablated(spark, tmp_path):
    rows = spark.range(300).select(F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 5 == 0).alias("held")).withColumn("y", F.col("a") * 2 + F.col("b") * 0.1)
    fitted = model.train(rows, ["a", "b"], "y", 5)
    model.save(fitted, ["a", "b"], str(tmp_path / "m"))
    again, names = model.load(str(tmp_path / "m"))
    assert names == ["a", "b"]
    want = [r[0] for r in model.predict(fitted, rows, names).select("score").collect()]
    assert [r[0] for r in model.predict(again, rows, names).select("score").collect()] == want
    out = {r["mode"]: r["rmse"] for r in model.ablations(rows, names, "y", {"no_a": ["a"]}, 10, "held").collect()}
    assert out["full"] < out["no_a"]
