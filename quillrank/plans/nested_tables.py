"""p1: the child tables of nested records and of raw payload lines."""

from __future__ import annotations

from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tables import table
from quillrank.operators.shredding import assemble, places, shred
from quillrank.sources.payloads import NAMING_FIELD, payload_records

ROOTS = ["career_history", "education", "skills", "redrob_signals"]


def child_entries(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Every entry with a value, as (key, child_table, item_no, item_key), in one pass over the records.

    Null records, null or empty lists, null entries and entries without any value give no row; null and
    valueless entries still count for the place of those after them. A null name gives the empty text.
    Records given twice come out twice.
    """
    levels, found = shred(records, ROOTS, [key])
    signals = [x for x in found if x.path.startswith("redrob_signals")]
    scores = "redrob_signals.skill_assessment_scores"

    def made(name: str, place, item, rows):
        return F.transform(rows, lambda e: F.struct(F.lit(name).alias("child_table"), place(e).cast("int").alias("item_no"), F.coalesce(item(e), F.lit("")).alias("item_key")))

    parts = [
        made(name, itemgetter("at"), itemgetter(named), F.filter(places(found, name), lambda e: e["there"]))
        for name, named in NAMING_FIELD.items()
    ]
    # The record's own struct is a list of at most one: any of its leaves with a value makes it a row.
    has_value = F.lit(False)
    for x in signals:
        has_value = has_value | F.array_contains(F.col(f"`{x.path}`")["d"], x.max_def)
    one = F.struct(F.lit("redrob_signals").alias("child_table"), F.lit(0).alias("item_no"), F.lit("").alias("item_key"))
    parts.append(F.when(has_value, F.array(one)).otherwise(F.filter(F.array(one), lambda _: F.lit(False))))
    assessed = F.filter(places(found, scores), lambda e: e["value"].isNotNull())
    parts.append(made("skill_assessment_scores", lambda e: F.lit(-1), lambda e: e["key"], assessed))
    return levels.select(key, F.inline(F.concat(*parts)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "candidates").select("record_id", *ROOTS)
    raw = payload_records(table(spark, sf_dir, "candidate_lines"), "record_id", "payload").select("record_id", *ROOTS)
    return child_entries(stored).unionByName(child_entries(raw))


def child_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole child table of ``candidates`` with all its leaves, parent key and place."""
    levels, found = shred(table(spark, sf_dir, "candidates").select("record_id", name), [name], ["record_id"])
    return assemble(levels, found, name, ["record_id"])


def child_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_table(spark, sf_dir, "skills")


def level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each leaf of the jobs: entries by repetition and definition level."""
    levels, found = shred(table(spark, sf_dir, "candidates").select("record_id", "career_history"), ["career_history"], ["record_id"])
    each = F.flatten(F.array(*(_tagged(x.path) for x in found)))
    return levels.select(F.inline(each)).groupBy("path", "r", "d").agg(F.count(F.lit(1)).alias("n"))


def _tagged(path: str):
    return F.transform(F.col(f"`{path}`"), lambda e: F.struct(F.lit(path).alias("path"), e["r"].alias("r"), e["d"].alias("d")))


CHILD_SKILLS_SQL = """
SELECT record_id, CAST(k - 1 AS INT) AS item_no, s.name AS name, s.proficiency AS proficiency, s.endorsements AS endorsements, s.duration_months AS duration_months
FROM (SELECT record_id, unnest(skills) AS s, generate_subscripts(skills, 1) AS k FROM candidates)
"""
_JOB_FIELDS = ["title", "company", "industry", "company_size", "description", "duration_months", "start_date", "end_date", "is_current"]
LEVELS_SQL = """
WITH e AS (SELECT unnest(career_history) AS j, generate_subscripts(career_history, 1) AS k FROM candidates),
l AS (
  SELECT 0 AS r, CASE WHEN career_history IS NULL THEN 0 ELSE 1 END AS d, NULL AS f FROM candidates WHERE coalesce(len(career_history), 0) = 0)
""" + " UNION ALL ".join(f"SELECT 'career_history.{f}' AS path, r, d, count(*) AS n FROM (SELECT r, d FROM l UNION ALL SELECT CASE WHEN k = 1 THEN 0 ELSE 1 END, CASE WHEN j IS NULL THEN 2 WHEN j.{f} IS NULL THEN 3 ELSE 4 END FROM e) GROUP BY 1, 2, 3" for f in _JOB_FIELDS)
