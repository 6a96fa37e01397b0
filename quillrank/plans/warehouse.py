"""The operators on the relational tables: sessions, windows, joins, nested rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions.tables import table
from quillrank.operators.features import notice_penalty, yoe_fit
from quillrank.operators.text import any_contains, count_contains, either_contains
from quillrank.plans.records import ROLLUP_SQL

KEYWORDS = ["hot", "gear", "bolt", "red", "ring"]


def part_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", any_contains(name, KEYWORDS).cast("int").alias("any_hit"), count_contains(name, KEYWORDS).alias("n_hits"), either_contains(name, KEYWORDS).cast("int").alias("either"))


def shipping_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose claimed months exceed the whole months from order to shipping by more than twelve."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = l.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    months = (F.year("l_shipdate") - F.year("o_orderdate")) * 12 + F.month("l_shipdate") - F.month("o_orderdate")
    return j.where(F.col("l_quantity") > months + 12).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.min(months).cast("int").alias("least_months"))


def early_shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = l.select("l_orderkey", "l_shipdate").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_custkey"), "l_orderkey")
    return j.groupBy("o_custkey").agg(F.sum((F.col("l_shipdate") < F.col("o_orderdate")).cast("int")).alias("n_early"), F.count(F.lit(1)).alias("n_lines"))


def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one customer's orders less than thirty days apart: a range join bucketed by thirty days."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    day = F.floor(F.datediff("d", F.to_date(F.lit("1990-01-01"))) / 30).cast("int")
    a = o.select("o_custkey", F.col("o_orderkey").alias("ka"), F.col("d").alias("da"), F.explode(F.array(day - 1, day, day + 1)).alias("bucket"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("kb"), F.col("d").alias("db"), day.alias("bucket"))
    near = a.join(b, ["o_custkey", "bucket"]).where("ka < kb and abs(datediff(da, db)) < 30")
    return near.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_pairs"))


def last_order_before_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join without a join: both tables in one ordering, the last order carried to the events after it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("bigint").alias("o"), F.lit(1).alias("_side"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(None).cast("bigint").alias("event_id"), F.col("o_orderkey").alias("o"), F.lit(0).alias("_side"))
    w = W.partitionBy("k").orderBy("t", "_side", "o").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = e.unionByName(o).withColumn("o_orderkey", F.last("o", ignorenulls=True).over(w))
    return both.where("_side = 1").select("event_id", "o_orderkey")


def user_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    days = F.datediff(F.to_date(F.lit("2024-02-01")), F.max("ts").cast("date"))
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    g = e.groupBy("user_id").agg(days.alias("days"), share("purchase").alias("bought"), share("error").alias("failed"), F.max((F.col("event_type") == "signup").cast("int")).alias("signed"), F.sum((F.col("event_type") == "click").cast("int")).alias("clicks"))
    recency = F.greatest(F.lit(0.0), 1 - F.col("days") / 5)
    mixed = F.pow(recency, F.lit(0.5)) * F.pow(F.col("bought"), F.lit(0.3)) * F.pow(1 - F.col("failed"), F.lit(0.2)) * F.when(F.col("signed") == 1, 1.1).otherwise(0.9)
    return g.select("user_id", F.round(recency, 6).alias("recency"), F.round(F.least(F.lit(1.1), F.greatest(F.lit(0.0), mixed)), 6).alias("composite"), F.round(F.log1p("clicks"), 6).alias("log_clicks"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.expr("try_cast(get_json_object(props, '$.k') AS bigint)").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.streaming.events import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def hourly_events_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream over the table's file."""
    from quillrank.streaming.events import file_stream, run_to_table, windowed_counts

    out = run_to_table(windowed_counts(file_stream(spark, f"{sf_dir}/events.parquet")), "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def records_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each record of a stream of candidates is implausible."""
    from quillrank.streaming.events import checked_records, file_stream, run_to_table

    out = run_to_table(checked_records(file_stream(spark, f"{sf_dir}/candidates.parquet")), "append")
    return out.select("record_id", "is_implausible", F.size("findings").alias("n_findings"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events with gaps of at most an hour."""
    e = table(spark, sf_dir, "events").withColumn("_t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("_t", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def piecewise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(yoe_fit(F.col("p_size") / 2.5), 6).alias("fit"), F.round(notice_penalty(F.col("p_size") * 4), 6).alias("penalty"))


def tenure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: product share of quantities, longest, mean, and the flag of at least three short ones."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.col("l_partkey").alias("p_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_type") != "PROMO").alias("product"))
    g = l.join(p, "p_partkey").groupBy("l_orderkey").agg(F.sum(F.when(F.col("product"), F.col("l_quantity")).otherwise(0.0)).alias("a"), F.sum("l_quantity").alias("b"), F.max("l_quantity").alias("longest"), F.avg("l_quantity").alias("m"), F.count(F.lit(1)).alias("n"), F.max("product").alias("any_product"))
    return g.select("l_orderkey", F.round(F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0), 6).alias("ratio"), "longest", F.round("m", 6).alias("mean"), ((F.col("n") >= 3) & (F.col("m") < 18)).cast("int").alias("short_stays"), (~F.col("any_product")).cast("int").alias("only_promo"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2001-01-01 00:00:00'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(net), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return l.join(o, "o_orderkey").join(c.select("c_custkey", "r_name"), "c_custkey").groupBy("r_name").agg(F.round(F.sum("v"), 2).alias("revenue"), F.count(F.lit(1)).alias("n_orders"))


_E = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_HOURS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _hits(join: str) -> str:
    return f" {join} ".join(f"contains(lower(p_name), '{k}')" for k in KEYWORDS)


QUERIES = {
    "part_keywords": (part_keywords, f"SELECT p_partkey, CAST({_hits('OR')} AS INT) AS any_hit, CAST({' + '.join(f'CAST(contains(lower(p_name), {chr(39)}{k}{chr(39)}) AS INT)' for k in KEYWORDS)} AS INT) AS n_hits, CAST({' OR '.join(f'contains(lower(p_name), {chr(39)}{k}{chr(39)}) OR contains({chr(39)}{k}{chr(39)}, lower(p_name))' for k in KEYWORDS)} AS INT) AS either FROM part"),
    "shipping_span": (shipping_span, "WITH j AS (SELECT l_orderkey, l_quantity AS q, (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, count(*) AS n_lines, CAST(min(m) AS INT) AS least_months FROM j WHERE q > m + 12 GROUP BY 1"),
    "early_shipping": (early_shipping, "SELECT o_custkey, CAST(sum(CAST(l_shipdate < o_orderdate AS INT)) AS BIGINT) AS n_early, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "overlapping_orders": (overlapping_orders, "SELECT a.o_custkey, count(*) AS n_pairs FROM orders AS a JOIN orders AS b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE)) < 30 GROUP BY 1"),
    "last_order_before_event": (last_order_before_event, "WITH x AS (SELECT event_id, o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k FROM events LEFT JOIN orders ON o_custkey = user_id AND o_orderdate <= ts) SELECT event_id, o_orderkey FROM x WHERE k = 1"),
    "user_recency": (
        user_recency,
        """WITH g AS (SELECT user_id, greatest(0.0::DOUBLE, 1 - (DATE '2024-02-01' - CAST(max(ts) AS DATE)) / 5) AS r, avg(CAST(event_type = 'purchase' AS INT)) AS b, avg(CAST(event_type = 'error' AS INT)) AS f, max(CAST(event_type = 'signup' AS INT)) AS s, sum(CAST(event_type = 'click' AS INT)) AS c FROM events GROUP BY 1)
SELECT user_id, round(r, 6) AS recency, round(least(1.1::DOUBLE, greatest(0.0::DOUBLE, pow(r, 0.5) * pow(b, 0.3) * pow(1 - f, 0.2) * (CASE WHEN s = 1 THEN 1.1 ELSE 0.9 END))), 6) AS composite, round(ln(1 + c), 6) AS log_clicks FROM g""",
    ),
    "event_properties": (event_properties, f"SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM {_E} GROUP BY 1"),
    "hourly_events": (hourly_events, _HOURS),
    "hourly_events_streamed": (hourly_events_streamed, _HOURS),
    "records_streamed": (records_streamed, f"SELECT record_id, is_implausible = 1 AS is_implausible, n_findings FROM ({ROLLUP_SQL})"),
    "user_sessions": (
        user_sessions,
        """WITH g AS (SELECT user_id, ts, event_id, CAST(coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR, true) AS INT) AS fresh FROM events),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY 1""",
    ),
    "piecewise_scores": (
        piecewise_scores,
        """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 2.5 AS y, p_size * 4 AS d FROM part)
SELECT p_partkey, round(CASE WHEN y < 2 THEN 0 WHEN y <= 6 THEN (y - 2) / 4 WHEN y <= 8 THEN 1 WHEN y <= 12 THEN greatest(0.5, 1 - (y - 8) / 8) ELSE greatest(0.2, 0.5 - (y - 12) / 20) END, 6) AS fit,
  round(CASE WHEN d <= 30 THEN 0 WHEN d >= 180 THEN 1 ELSE (d - 30) / 150 END, 6) AS penalty FROM p""",
    ),
    "tenure_flags": (tenure_flags, "SELECT l_orderkey, round(CASE WHEN sum(l_quantity) > 0 THEN sum(CASE WHEN p_type <> 'PROMO' THEN l_quantity ELSE 0 END) / sum(l_quantity) ELSE 0 END, 6) AS ratio, max(l_quantity) AS longest, round(avg(l_quantity), 6) AS mean, CAST(count(*) >= 3 AND avg(l_quantity) < 18 AS INT) AS short_stays, CAST(bool_and(p_type = 'PROMO') AS INT) AS only_promo FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01' GROUP BY 1, 2"),
    "revenue_by_region": (revenue_by_region, "SELECT r_name, round(sum(v), 2) AS revenue, count(*) AS n_orders FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
}
