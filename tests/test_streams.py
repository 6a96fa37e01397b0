"""Streams over tables that are one file and over tables that are folders of parts."""

import pytest
from conftest import DATA, rows

from quillrank.functions.tables import table
from quillrank.plans.registry import QUERIES


@pytest.mark.parametrize("query, name", [("records_streamed", "candidates"), ("hourly_events_streamed", "events")])
@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_of_parts_is_streamed_whole(spark, tmp_path, query, name, parts):
    df = table(spark, f"{DATA}/sf0.001", name)
    df.repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    assert len(list((tmp_path / f"{name}.parquet").glob("*.parquet"))) == parts
    want, got = (rows(QUERIES[query](spark, d)) for d in (f"{DATA}/sf0.001", str(tmp_path)))
    assert got == want and want


def test_an_empty_table_of_parts(spark, empty_dir):
    assert QUERIES["records_streamed"](spark, empty_dir).collect() == []


def test_columns_that_are_folders_come_along(spark, tmp_path):
    from quillrank.streaming.events import file_stream, run_to_table

    df = spark.range(6).selectExpr("id", "cast(id % 2 as int) as k")
    df.write.partitionBy("k").parquet(f"{tmp_path}/t.parquet")
    assert rows(run_to_table(file_stream(spark, f"{tmp_path}/t.parquet"), "append")) == rows(df)
