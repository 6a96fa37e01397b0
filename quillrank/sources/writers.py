"""Writing rankings, labels and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKING_COLUMNS = ["candidate_id", "rank", "score", "reasoning"]


def write_ranking(df: DataFrame, path: str, rows: int = 100) -> None:
    """The first ``rows`` of a ranking as one CSV with a header, scores rounded half to even to six places."""
    top = df.orderBy("rank").limit(rows).select("candidate_id", "rank", F.bround(F.col("score"), 6).alias("score"), "reasoning")
    top.coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(path)


def write_labels(df: DataFrame, path: str) -> None:
    """Labels without any further columns they may have."""
    df.select("candidate_id", "score", "rationale", "stratum").write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_row(df: DataFrame, path: str) -> None:
    """One more row of a log table, such as the result of an ablation."""
    df.coalesce(1).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines: a sample for labelling, or stated texts with their marks."""
    df.write.mode("overwrite").json(path)


def ranking_lines(df: DataFrame, rows: int | None = None) -> DataFrame:
    """(rank, line): a ranking as CSV text, scores with six places; the first ``rows`` or all. Cells are quoted where needed."""
    top = df.orderBy("rank").limit(rows) if rows is not None else df
    cells = F.struct("candidate_id", "rank", F.format_string("%.6f", F.bround(F.col("score").cast("double"), 6)).alias("score"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))
    return top.select("rank", F.to_csv(cells).alias("line"))


def id_lines(df: DataFrame) -> DataFrame:
    """The distinct ids alone, one a line."""
    return df.select(F.col("candidate_id").alias("line")).where("line is not null").distinct()
