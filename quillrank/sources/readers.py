"""Reading records, labels and rankings from files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATE_DDL = (
    "candidate_id string, profile struct<anonymized_name:string,headline:string,summary:string,current_title:string,current_company_size:string,years_of_experience:double,country:string,location:string>, "
    "career_history array<struct<title:string,company:string,industry:string,company_size:string,description:string,duration_months:int,start_date:string,end_date:string,is_current:boolean>>, "
    "education array<struct<degree:string,field_of_study:string,institution:string,tier:string,end_year:int>>, "
    "skills array<struct<name:string,proficiency:string,endorsements:int,duration_months:int>>, "
    "redrob_signals struct<skill_assessment_scores:map<string,double>,github_activity_score:double,notice_period_days:int,expected_salary_range_inr_lpa:struct<min:double,max:double>,preferred_work_mode:string,willing_to_relocate:boolean,last_active_date:string,signup_date:string,open_to_work_flag:boolean,recruiter_response_rate:double,interview_completion_rate:double,applications_submitted_30d:int,saved_by_recruiters_30d:int,profile_completeness_score:double,verified_email:boolean,verified_phone:boolean>"
)
CORRUPT = "_corrupt_record"
LABEL_FIELDS = "candidate_id string, score double, rationale string, stratum string"


def is_json_array(spark: SparkSession, path: str) -> bool:
    """True if the first character that is no white space is a bracket; reads no more than the first lines."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.ltrim(F.regexp_replace("value", "^﻿", ""))).head()
    return bool(first) and first[0].startswith("[")


def read_candidates(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Candidates of JSON-lines files or of files with one JSON array; blank lines are skipped.

    A folder may hold both: names in .jsonl or .ndjson are lines, the rest is told by its first character. Broken
    records keep their text in ``_corrupt_record``; with ``strict`` they end the read. Any file system that
    Spark reads will do.
    """
    schema = T.StructType.fromDDL(CANDIDATE_DDL).add(CORRUPT, T.StringType())
    reader = lambda: spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if re.search(r"\.(jsonl|ndjson)$", path):
        return reader().json(path)
    if re.search(r"\.json$", path):
        return reader().option("multiLine", is_json_array(spark, path)).json(path)
    named = {glob: spark.read.option("pathGlobFilter", glob).text(path) for glob in ("*.{jsonl,ndjson}", "*.json")}
    if all(df.isEmpty() for df in named.values()):
        return reader().option("multiLine", is_json_array(spark, path)).json(path)
    lists = bool(first) and first[0].startswith("[") if (first := named["*.json"].where(F.trim("value") != "").limit(1).select(F.ltrim("value")).head()) else False
    return reader().option("pathGlobFilter", "*.{jsonl,ndjson}").json(path).unionByName(reader().option("pathGlobFilter", "*.json").option("multiLine", lists).json(path))


def read_candidate_list(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_candidates`` of one file whose top level has to be a list; a ValueError if it is not."""
    if not is_json_array(spark, path):
        raise ValueError(f"{path}: the top level has to be a list")
    return read_candidates(spark, path, strict=True)


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the last by ``order``; rows without a key are left out."""
    rest = [c for c in df.columns if c != key]
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, candidate_id, score, rationale, stratum) of label files.

    A file is a list of labels or an object that has them under labels, results, candidates or scores, the
    first of these that is there; a leading byte order mark is ignored. Files that are neither give no rows.
    """
    rows = f"array<struct<{LABEL_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_name"), F.regexp_replace("value", "^﻿", "").alias("t"))
    named = F.from_json("t", "struct<" + ",".join(f"{k}:{rows}" for k in ("labels", "results", "candidates", "scores")) + ">")
    as_list = F.from_json("t", rows)
    found = whole.select("file_name", F.when(F.ltrim("t").startswith("["), as_list).otherwise(F.coalesce(*(named[k] for k in ("labels", "results", "candidates", "scores")))).alias("_l"))
    return found.select("file_name", F.inline("_l"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, score) of a CSV with a header; other columns are not read on."""
    return spark.read.option("header", True).csv(path).select("candidate_id", F.expr("try_cast(score AS double)").alias("score"))


def json_array_in(text):
    """The JSON text between the first [ and the last ] of a reply, code fences or not; null if there is none."""
    first, last = F.instr(text, "["), F.length(text) - F.instr(F.reverse(text), "]") + 1
    return F.when((first > 0) & (F.instr(text, "]") > 0) & (last > first), F.substring(text, first, last - first + 1))


def drive_id(url):
    """The file id in a shared-drive address; null for others."""
    out = F.coalesce(F.nullif(F.regexp_extract(url, r"/d/([a-zA-Z0-9_-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]id=([a-zA-Z0-9_-]+)", 1), F.lit("")))
    return out


def read_finalists(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, rank) of a ranking written as CSV with a header; rows without a value in any cell are skipped."""
    rows = spark.read.option("header", True).csv(path)
    filled = rows.where(F.trim(F.concat_ws("", *rows.columns)) != "")
    return filled.select(F.trim("candidate_id").alias("candidate_id"), F.expr("try_cast(trim(rank) AS int)").alias("rank"))


def read_artifact(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A kept table, or an empty one of the schema where it is missing."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ddl)


def read_text(spark: SparkSession, path: str, fallback: str = "") -> str:
    """A text document whole, or the fallback where it is missing or blank. For parameters, such as a role's text."""
    try:
        row = spark.read.text(path, wholetext=True).head()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    return row[0] if row and row[0].strip() else fallback
