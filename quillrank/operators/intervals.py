"""Overlapping time intervals to unbroken periods and the gaps between them.

Starts and ends of an entity are sorted independently of each other. With s and e so ranked, coverage breaks
after rank i exactly where s[i+1] lies beyond e[i] (more than one day, as both dates belong to the interval):
i+1 intervals have begun by then and as many have ended. A period begins at each start that follows a break
and ends at the end before the next one.

``row_periods`` does it inside one row for an array of intervals. ``merge_intervals`` does it for a table
with one interval per row; a hot entity is first merged within spans of time, so what meets in one place is
its periods per span, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_TIME = r"([T ]\d{1,2}:\d{2}(:\d{2})?([.,]\d+)?\s*(Z|[+-]\d{2}:?\d{2})?)?"
_NUMERIC = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_DAY_MONTH = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ -]+([A-Za-z]{{3,9}})\.?,?[ -]+(\d{{4}}){_TIME}$"
_MONTH_DAY = rf"^([A-Za-z]{{3,9}})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}}){_TIME}$"
_YEAR_MONTH = r"^(\d{4})[-/.](\d{1,2})$"
_MONTH_YEAR = r"^([A-Za-z]{3,9})\.?,?[ -]+(\d{4})$"
_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _month_number(name: Column) -> Column:
    """1 to 12 of an English month name, whole or cut to three or four letters; null for any other word."""
    forms = {short: str(k + 1) for k, full in enumerate(_NAMES) for short in (full[:3], full[:4], full)}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in forms.items() for x in pair)), F.lower(name))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def written_date(text: Column, end: bool = False) -> Column:
    """The day a text names, or of a named month its first day (its last where ``end``); null for other texts.

    Years come first or last as four digits; a time of day is ignored; outer white space too. Texts that
    name no existing day (2024-13-40, 30 Feb 2020) are null.
    """
    t = F.btrim(text, F.lit(" \t\r\n\u00a0"))
    g = lambda pattern, k: F.regexp_extract(t, pattern, k)
    month = F.when(t.rlike(_YEAR_MONTH), _day(g(_YEAR_MONTH, 1), g(_YEAR_MONTH, 2), F.lit("1"))).when(t.rlike(_MONTH_YEAR), _day(g(_MONTH_YEAR, 2), _month_number(g(_MONTH_YEAR, 1)), F.lit("1")))
    return (
        F.when(t.rlike(_NUMERIC), _day(g(_NUMERIC, 1), g(_NUMERIC, 2), g(_NUMERIC, 3)))
        .when(t.rlike(_DAY_MONTH), _day(g(_DAY_MONTH, 3), _month_number(g(_DAY_MONTH, 2)), g(_DAY_MONTH, 1)))
        .when(t.rlike(_MONTH_DAY), _day(g(_MONTH_DAY, 3), _month_number(g(_MONTH_DAY, 1)), g(_MONTH_DAY, 2)))
        .when(t.rlike(_COMPACT), _day(g(_COMPACT, 1), g(_COMPACT, 2), g(_COMPACT, 3)))
        .otherwise(F.last_day(month) if end else month)
    )


def row_periods(starts: Column, ends: Column) -> Column:
    """array<struct<kind, from_date, to_date>> of periods and gaps; both arrays sorted, of one length.

    Null or empty arrays give an empty array.
    """
    def after_break(i: Column) -> Column:
        return (i == 0) | (starts[i] > F.date_add(F.get(ends, i - 1), 1))

    n = F.size(starts)
    opened = F.filter(F.transform(starts, lambda s, i: F.when(after_break(i), i)), lambda i: i.isNotNull())

    def listed(o: Column) -> Column:
        last = lambda k: F.coalesce(F.get(o, k + 1), n) - 1
        periods = F.transform(o, lambda i, k: F.struct(F.lit("period").alias("kind"), F.get(starts, i).alias("from_date"), F.get(ends, last(k)).alias("to_date")))
        gaps = F.transform(F.filter(o, lambda i: i > 0), lambda i: F.struct(F.lit("gap").alias("kind"), F.date_add(F.get(ends, i - 1), 1).alias("from_date"), F.date_sub(F.get(starts, i), 1).alias("to_date")))
        return F.concat(periods, gaps)

    # The places of breaks are bound once: a transform over a list of one.
    return F.coalesce(F.transform(F.array(opened), listed)[0], F.array().cast("array<struct<kind:string,from_date:date,to_date:date>>"))


def _ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Periods per ``keys`` from starts and ends ranked independently; windows spill, nothing is collected."""
    s = df.select(*keys, F.col("_s").alias("_x"), F.lit(0).alias("_end"))
    e = df.select(*keys, F.date_add("_e", 1).alias("_x"), F.lit(1).alias("_end"))
    # In one ordering of all boundaries (starts first on a tie) the open intervals are starts less ends so
    # far: the k-th start lies beyond the k-1-th end exactly where that count was 0 before it.
    w = W.partitionBy(*keys).orderBy("_x", "_end").rowsBetween(W.unboundedPreceding, W.currentRow)
    b = s.unionByName(e).withColumn("_open", F.sum(1 - 2 * F.col("_end")).over(w))
    edge = b.where(((F.col("_end") == 0) & (F.col("_open") == 1)) | ((F.col("_end") == 1) & (F.col("_open") == 0)))
    nxt = W.partitionBy(*keys).orderBy("_x", "_end")
    paired = edge.withColumn("_to", F.lead("_x").over(nxt))
    return paired.where("_end = 0").select(*keys, F.col("_x").alias("_s"), F.date_sub("_to", 1).alias("_e"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, kind, from_date, to_date) of a table with one interval per row; dates inclusive.

    Rows with a null date, or that end before they start, are left out; repeated rows change nothing. Null
    keys are a key of their own. ``keys`` may hold a hot entity: its rows are first made distinct, then
    merged per year of their start, which bounds what one task sorts by days and not by rows.
    """
    rows = df.select(*keys, F.col(start).cast("date").alias("_s"), F.col(end).cast("date").alias("_e")).where("_s <= _e")
    longest = rows.groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))
    local = _ranked(longest.withColumn("_span", F.year("_s")), [*keys, "_span"]).drop("_span")
    merged = _ranked(local, keys)
    following = F.lead("_s").over(W.partitionBy(*keys).orderBy("_s"))
    both = merged.withColumn("_next", following)
    return both.select(
        *keys,
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("_s").alias("from_date"), F.col("_e").alias("to_date")),
                    F.struct(F.lit("gap").alias("kind"), F.date_add("_e", 1).alias("from_date"), F.date_sub("_next", 1).alias("to_date")),
                ),
                lambda x: x["to_date"].isNotNull(),
            )
        ),
    )
