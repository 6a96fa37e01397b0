import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from quillrank.operators.intervals import merge_intervals, row_periods, written_date
from quillrank.plans.employment import p2_found


def brute(spans):
    days = sorted({d for s, e in spans for d in range(s, e + 1)})
    out, start = [], None
    for k, d in enumerate(days):
        start = d if start is None else start
        if k + 1 == len(days) or days[k + 1] != d + 1:
            out.append(("period", start, d))
            if k + 1 < len(days):
                out.append(("gap", d + 1, days[k + 1] - 1))
            start = None
    return sorted(out)


DAY = dt.date(2020, 12, 20)


def test_against_days(spark):
    import random

    random.seed(5)
    cases = [[(a, a + random.randrange(0, 12)) for a in (random.randrange(0, 60) for _ in range(random.randrange(0, 7)))] for _ in range(150)]
    day = lambda k: DAY + dt.timedelta(k)
    table = spark.createDataFrame([(i, sorted(day(s) for s, _ in c), sorted(day(e) for _, e in c)) for i, c in enumerate(cases)], "id int, s array<date>, e array<date>")
    got = {}
    for i, k, a, b in table.select("id", F.inline(row_periods(F.col("s"), F.col("e")))).collect():
        got.setdefault(i, []).append((k, (a - DAY).days, (b - DAY).days))
    flat = spark.createDataFrame([(i, day(s), day(e)) for i, c in enumerate(cases) for s, e in c * 2], "id int, s date, e date")
    merged = {}
    for i, k, a, b in merge_intervals(flat, ["id"], "s", "e").collect():
        merged.setdefault(i, []).append((k, (a - DAY).days, (b - DAY).days))
    for i, c in enumerate(cases):
        assert sorted(got.get(i, [])) == brute(c) == sorted(merged.get(i, []))


def test_written_dates(spark):
    texts = {"2024-02-29": "2024-02-29", " 2020/01/02": "2020-01-02", "2023-02-30": None, "2024-13-40": None, "3 May 2020": "2020-05-03", "Feb 2020": "2020-02-29", "2020-02": "2020-02-29", "2020-05-06T09:30:00Z": "2020-05-06", "2020-05-06 00:00:00": "2020-05-06", "present": None, "": None, "20th century": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] and str(r[1]) for r in df.select("t", written_date(F.col("t"), end=True)).collect()}
    assert got == texts
    assert str(spark.createDataFrame([("Feb 2020",)], "t string").select(written_date(F.col("t"))).head()[0]) == "2020-02-01"


def test_edge_records(spark, edge_dir):
    got = rows(p2_found(spark, edge_dir))
    assert (1, "period", "2020-01-01", "2020-12-31") in got and (6, "period", "2021-06-01", "2021-12-31") in got
    assert not [r for r in got if r[0] in (3, 4)]


def test_empty(spark, empty_dir):
    assert rows(p2_found(spark, empty_dir)) == []
    assert rows(merge_intervals(spark.createDataFrame([], "id int, s date, e date"), ["id"], "s", "e")) == []
