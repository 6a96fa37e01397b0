"""Every core query with SQL against DuckDB, and the sources and sinks."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillrank.plans.registry import QUERIES, SQL
from quillrank.sources import readers, writers

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, float) or hasattr(x, "as_integer_ratio") else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == want


def test_candidates_as_lines_and_as_array(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"candidate_id":"CAND_0000001"}\n\n{"candidate_id":"CAND_0000001","profile":{"headline":"later"}}\n{broken\n')
    (tmp_path / "b.json").write_text('\n [{"candidate_id":"CAND_0000002"}]')
    a = readers.read_candidates(spark, str(tmp_path / "a.jsonl")).cache()
    assert a.count() == 3 and a.where(f"{readers.CORRUPT} is not null").count() == 1
    assert [r[0] for r in readers.read_candidates(spark, str(tmp_path / "b.json")).select("candidate_id").collect()] == ["CAND_0000002"]
    with pytest.raises(Exception):
        readers.read_candidates(spark, str(tmp_path / "a.jsonl"), strict=True).collect()


def test_labels_in_every_wrapping(spark, tmp_path):
    for k, text in enumerate(['[{"candidate_id":"a","score":0.2}]', "﻿" + '{"labels":[{"candidate_id":"b","score":1}]}', '{"results":[{"candidate_id":"c"}],"scores":[{"candidate_id":"no"}]}', '{"scores":[{"candidate_id":"d","stratum":"s"}]}', "{", ""]):
        (tmp_path / f"result_{k}.json").write_text(text, encoding="utf-8")
    got = {(r["candidate_id"], r["score"]) for r in readers.read_labels(spark, str(tmp_path)).collect()}
    assert got == {("a", 0.2), ("b", 1.0), ("c", None), ("d", None)}


def test_ranking_written_as_one_csv(spark, tmp_path):
    df = spark.createDataFrame([("CAND_0000002", 2, 0.12345650, "b"), ("CAND_0000001", 1, 0.5, "a")], "candidate_id string, rank int, score double, reasoning string")
    writers.write_ranking(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0] == "candidate_id,rank,score,reasoning" and text[1].startswith("CAND_0000001,1,0.5") and len(text) == 3


def test_json_in_replies_and_drive_ids(spark):
    df = spark.createDataFrame([("```json\n[1, 2]\n``` done", "https://x/d/abc_1/view"), ("none", "https://x/open?id=Q-9"), (None, None)], "t string, u string")
    got = df.select(readers.json_array_in(F.col("t")), readers.drive_id(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("[1, 2]", "abc_1"), (None, "Q-9"), (None, None)]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 50
