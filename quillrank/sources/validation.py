"""Checks of rankings written as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators.ranking import violations
from quillrank.sources.writers import RANKING_COLUMNS


def file_violations(spark: SparkSession, path: str, rows: int = 100) -> DataFrame:
    """(file, code, n): what is wrong with each ranking file of a path.

    Codes of the file: suffix (not .csv), encoding (bytes that are not UTF-8), header (not the stated columns in
    their order), cells (rows with another number of cells); then those of ``operators.ranking.violations`` over
    the rows that are not blank. A file is read whole by one task: a ranking has a hundred rows.
    """
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    text = whole.select("file", F.expr("try_validate_utf8(cast(content as string))").alias("_t"))
    lines = text.select("file", F.col("_t").isNull().alias("_bad"), F.filter(F.split(F.regexp_replace(F.coalesce("_t", F.lit("")), "^\ufeff", ""), r"\r?\n"), lambda x: F.trim(F.translate(x, ",", "")) != "").alias("_l"))
    cells = lambda x: F.from_csv(x, ", ".join(f"c{k} string" for k in range(len(RANKING_COLUMNS) + 1)))
    head = F.array_join(F.transform(F.split(F.coalesce(F.get("_l", F.lit(0)), F.lit("")), ","), F.trim), ",")
    files = lines.select("file", (~F.col("file").endswith(".csv")).alias("suffix"), F.col("_bad").alias("encoding"), (head != ",".join(RANKING_COLUMNS)).alias("header"))
    rest = lines.select("file", F.explode(F.slice("_l", 2, F.greatest(F.size("_l"), F.lit(1)))).alias("_x")).select("file", cells(F.col("_x")).alias("c"), F.col("_x"))
    last = f"c{len(RANKING_COLUMNS) - 1}"
    uneven = F.col(f"c.{last}").isNull() & ~F.col("_x").endswith(",") | F.col(f"c.c{len(RANKING_COLUMNS)}").isNotNull()
    off = rest.where(uneven).groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.lit("cells").alias("code"), "n")
    flags = files.select("file", F.inline(F.array(*(F.struct(F.lit(k).alias("code"), F.col(k).cast("bigint").alias("n")) for k in ("suffix", "encoding", "header"))))).where("n > 0")
    typed = rest.select("file", *(F.col(f"c.c{k}").alias(name) for k, name in enumerate(RANKING_COLUMNS)))
    return flags.unionByName(off).unionByName(violations(typed, "file", rows))
