"""p2: unbroken periods of employment and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tables import table
from quillrank.operators.intervals import merge_intervals, row_periods, written_date

REF_DATE = "2026-06-10"


def written_job(job: Column) -> Column:
    """The dates and numbers a job is given by, each text parsed once."""
    return F.struct(written_date(job["start_date"]).alias("s"), written_date(job["end_date"], end=True).alias("e"), job["duration_months"].alias("m"), job["is_current"].alias("c"))


def job_span(job: Column, ref_date: str = REF_DATE) -> Column:
    """struct<s, e> of a written job, null where it has no start or no end or ends before it starts."""
    counted = F.when(job["m"] > 0, F.date_sub(F.add_months(job["s"], job["m"]), 1))
    end = F.coalesce(job["e"], F.when(job["c"], F.to_date(F.lit(ref_date))).otherwise(counted))
    return F.when(job["s"] <= end, F.struct(job["s"].alias("s"), end.alias("e")))


def record_periods(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Periods and gaps of every record, in the row: no shuffle. Null or empty job lists give no rows."""
    written = F.transform("career_history", lambda j: F.when(j.isNotNull(), written_job(j)))
    spans = F.filter(F.transform(written, lambda j: job_span(j)), lambda x: x.isNotNull())
    ranked = records.select(key, spans.alias("_spans")).select(key, F.array_sort(F.col("_spans.s")).alias("_s"), F.array_sort(F.col("_spans.e")).alias("_e"))
    out = ranked.select(key, F.inline(row_periods(F.col("_s"), F.col("_e"))))
    return out.select(key, "kind", F.date_format("from_date", "yyyy-MM-dd").alias("from_date"), F.date_format("to_date", "yyyy-MM-dd").alias("to_date"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_periods(table(spark, sf_dir, "candidates"))


def customer_order_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table form of the operator: thirty days from each order of a customer, merged."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    merged = merge_intervals(orders.withColumn("until", F.date_add("d", 29)), ["o_custkey"], "d", "until")
    return merged.select("o_custkey", "kind", F.date_format("from_date", "yyyy-MM-dd").alias("from_date"), F.date_format("to_date", "yyyy-MM-dd").alias("to_date"))


P2_SQL = r"""
WITH jobs AS (
  SELECT record_id, unnest(career_history) AS j FROM candidates),
written AS (
  SELECT record_id, trim(j.start_date) AS s, trim(j.end_date) AS e, j.duration_months AS m, j.is_current AS c FROM jobs WHERE j IS NOT NULL),
parsed AS (
  SELECT record_id, m, c,
    coalesce(
      CASE WHEN regexp_matches(s, '^\d{4}[-/]\d{2}[-/]\d{2}([T ].*)?$') THEN TRY_CAST(replace(substr(s, 1, 10), '/', '-') AS DATE) END,
      CAST(try_strptime(s, '%d %b %Y') AS DATE), CAST(try_strptime(s, '%b %Y') AS DATE),
      CASE WHEN regexp_matches(s, '^\d{4}-\d{2}$') THEN TRY_CAST(s || '-01' AS DATE) END) AS s,
    coalesce(
      CASE WHEN regexp_matches(e, '^\d{4}[-/]\d{2}[-/]\d{2}([T ].*)?$') THEN TRY_CAST(replace(substr(e, 1, 10), '/', '-') AS DATE) END,
      CAST(try_strptime(e, '%d %b %Y') AS DATE), last_day(CAST(try_strptime(e, '%b %Y') AS DATE)),
      CASE WHEN regexp_matches(e, '^\d{4}-\d{2}$') THEN last_day(TRY_CAST(e || '-01' AS DATE)) END) AS e
  FROM written),
spans AS (
  SELECT record_id, s, coalesce(e, CASE WHEN c THEN DATE '2026-06-10' WHEN m > 0 THEN CAST(s + to_months(m) AS DATE) - 1 END) AS e FROM parsed),
good AS (SELECT * FROM spans WHERE s <= e),
flagged AS (
  SELECT record_id, s, e, coalesce(s > max(e) OVER (PARTITION BY record_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS fresh FROM good),
numbered AS (
  SELECT record_id, s, e, sum(CAST(fresh AS INT)) OVER (PARTITION BY record_id ORDER BY s, e, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM flagged),
periods AS (SELECT record_id, k, min(s) AS s, max(e) AS e FROM numbered GROUP BY 1, 2),
ahead AS (SELECT *, lead(s) OVER (PARTITION BY record_id ORDER BY k) AS nxt FROM periods)
SELECT record_id, 'period' AS kind, strftime(s, '%Y-%m-%d') AS from_date, strftime(e, '%Y-%m-%d') AS to_date FROM ahead
UNION ALL
SELECT record_id, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') FROM ahead WHERE nxt IS NOT NULL
"""

ORDER_PERIODS_SQL = """
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 29 AS e FROM orders),
f AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY o_custkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS fresh FROM d),
n AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY o_custkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM f),
p AS (SELECT o_custkey, k, min(s) AS s, max(e) AS e FROM n GROUP BY 1, 2),
a AS (SELECT *, lead(s) OVER (PARTITION BY o_custkey ORDER BY k) AS nxt FROM p)
SELECT o_custkey, 'period' AS kind, strftime(s, '%Y-%m-%d') AS from_date, strftime(e, '%Y-%m-%d') AS to_date FROM a
UNION ALL
SELECT o_custkey, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') FROM a WHERE nxt IS NOT NULL
"""
