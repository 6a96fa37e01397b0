"""Text construction and keyword operators as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def any_contains(text: Column, words: list[str]) -> Column:
    """True if any word is a substring; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), F.lit(False))


def count_contains(text: Column, words: list[str]) -> Column:
    """How many of the words are substrings, each once; 0 for null."""
    return F.coalesce(reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words)), F.lit(0))


def either_contains(text: Column, words: list[str]) -> Column:
    """True if a word is in the text or the text in a word; the empty text is in every word."""
    return F.coalesce(reduce(lambda a, b: a | b, (text.contains(w) | F.lit(w).contains(text) for w in words)), F.lit(False))


def entries(col: str | Column) -> Column:
    """A list without its null entries; empty for null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.filter(col, lambda x: x.isNotNull()), F.filter(F.array(col[0]), lambda _: F.lit(False)))


def career_text() -> Column:
    """Summary, headline and descriptions in lower case, joined by spaces."""
    return F.lower(F.concat_ws(" ", "profile.summary", "profile.headline", F.transform(entries("career_history"), lambda j: j["description"])))


def chunks() -> Column:
    """Text units of a record: a line a job that has a description, summary, headline; else its title."""
    jobs = F.filter(entries("career_history"), lambda j: F.coalesce(j["description"], F.lit("")) != "")
    lines = F.transform(jobs, lambda j: F.concat(F.coalesce(j["title"], F.lit("")), F.lit(" at "), F.coalesce(j["company"], F.lit("")), F.lit(": "), j["description"]))
    both = F.filter(F.array("profile.summary", "profile.headline"), lambda x: F.coalesce(x, F.lit("")) != "")
    every = F.concat(lines, both)
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.coalesce("profile.current_title", F.lit(""))))


def index_text() -> Column:
    """The text a lexical index holds of a record: headline, summary, titles, descriptions, skill names."""
    jobs = F.flatten(F.transform(entries("career_history"), lambda j: F.array(j["title"], j["description"])))
    return F.concat_ws(" ", "profile.headline", "profile.summary", "profile.current_title", jobs, F.transform(entries("skills"), lambda s: s["name"]))


def half_even(x: Column) -> Column:
    """A number as a whole-number text, halves to the even side."""
    return F.bround(x, 0).cast("bigint").cast("string")


def percent(x: Column) -> Column:
    """A share as whole percents, halves to the even side."""
    return F.concat(half_even(x * 100), F.lit("%"))


def year_month(text: Column) -> Column:
    """The year and month of a date as written; empty for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, 7)


def profile_text() -> Column:
    """A profile as running text: headline, summary, jobs with kind of company and description, skill names; empty parts are dropped."""
    both = lambda a, b, c: F.concat(F.coalesce(a, F.lit("")), F.lit(" at "), F.coalesce(b, F.lit("")), F.lit(": "), F.coalesce(c, F.lit("")))
    jobs = F.transform(entries("career_history"), lambda j: both(j["title"], j["company_size"], j["description"]))
    parts = F.concat(F.array("profile.headline", "profile.summary"), jobs, F.transform(entries("skills"), lambda s: s["name"]))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x != "", F.lit(False))), " ")


def rerank_passage(limit: int = 512) -> Column:
    """Summary, headline and the first three descriptions, 200 characters of each, cut to ``limit``."""
    first = F.transform(F.slice(entries("career_history"), 1, 3), lambda j: F.substring(j["description"], 1, 200))
    return F.substring(F.concat_ws(" ", "profile.summary", "profile.headline", first), 1, limit)


def labelling_payload() -> Column:
    """JSON of what a labeller sees: short summary, four jobs, five most endorsed skills, two schools."""
    jobs = F.transform(F.slice(entries("career_history"), 1, 4), lambda j: F.struct(j["title"].alias("title"), j["company"].alias("company"), j["industry"].alias("industry"), j["duration_months"].alias("duration_months"), F.substring(j["description"], 1, 200).alias("description")))
    ranked = F.array_sort(F.transform(entries("skills"), lambda s, i: F.struct((-F.coalesce(s["endorsements"], F.lit(0))).alias("o"), i.alias("i"), s["name"].alias("name"), s["proficiency"].alias("proficiency"), s["endorsements"].alias("endorsements"))))
    best = F.transform(F.slice(ranked, 1, 5), lambda s: F.struct(s["name"].alias("name"), s["proficiency"].alias("proficiency"), s["endorsements"].alias("endorsements")))
    schools = F.transform(F.slice(entries("education"), 1, 2), lambda e: F.struct(e["degree"].alias("degree"), e["field_of_study"].alias("field_of_study"), e["institution"].alias("institution")))
    return F.to_json(F.struct("candidate_id", F.col("profile.current_title").alias("current_title"), F.col("profile.years_of_experience").alias("years_of_experience"), F.substring("profile.summary", 1, 400).alias("summary"), jobs.alias("career"), best.alias("skills_top5"), schools.alias("education")))
