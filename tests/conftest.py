import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillrank.functions.tables import ship  # noqa: E402
from quillrank.sources.readers import CANDIDATE_DDL  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s


def job(company="Acorn Delta Systems", title="Data Engineer", industry="Banking", start="2020-01-01", end="2020-12-31", months=12, current=False, description="built things"):
    return (title, company, industry, "11-50", description, months, start, end, current)


def candidate(cid, jobs=None, schools=None, skills=None, signals=None, headline=None, summary=None, title=None):
    return (cid, ("Name N.", headline, summary, title, "11-50", 5.0, "India", "Pune"), jobs, schools, skills, signals)


NOW = dt.datetime(2026, 1, 1)
CLASH = {"n": 1, "at": "x", "value": "y", "ids": 3, "n_tokens": 4, "band": 9, "rank": 2, "share": 0.5, "mask": 7, "node": 8, "name": "z", "_n": 1, "kind": "k"}


def clashing(df):
    """With columns of the names that operators use inside."""
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})


def write(spark, rows, ddl, folder, name, empty=False):
    df = spark.createDataFrame([] if empty else rows, ddl)
    clashing(df).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


LONG = "the quick brown fox jumps over the lazy dog " * 4000


def edge_tables(spark, folder, empty):
    one = candidate("CAND_0000001", [job(), None, job(company=None, end=None, months=None, current=None)], [("BSc", "Maths", "Norda College of Engineering", "tier_1", 2010)], [("Python", "expert", 3, 0), None], None, "Head line", "some words", "Data Engineer")
    rows = [
        (1, *one, NOW), (2, *one, NOW), (3, None, None, None, None, None, None, None),
        (4, *candidate("CAND_0000002", [], [], [], None, "", "   ", ""), NOW),
        (5, *candidate("CAND_0000003", [job(company="  ", title=None, industry="")], None, None, ({"NLP": None, "SQL": 5.0},) + (None,) * 15, None, LONG, "   "), None),
        (6, *candidate("CAND_0000004", [(None,) * 9, job(company="Acorn Delta Systms", start="2021-06-01", end="Dec 2021")], [(None,) * 5], None, None, None, LONG + "end", "Dat Enginer"), NOW),
    ]
    write(spark, rows, f"record_id bigint, {CANDIDATE_DDL}, received_at timestamp_ntz", folder, "candidates", empty)
    payloads = ['{"candidate_id":"CAND_1","skills":[["a"],["b",null,{"name":"c"}]]}', "﻿" + '{"candidate":{"candidate_id":"CAND_2","education":{"institution":["X",null],"tier":[null,null]}}}', "{broken", "", None, "null", "[]", "12", '"[]"']
    write(spark, [(100 + k, "f", k, None, p) for k, p in enumerate(payloads)], "record_id bigint, file_name string, line_no int, received_at timestamp_ntz, payload string", folder, "candidate_lines", empty)
    labels = [(k, 1, "f", f"CAND_{k % 7:07d}", 0.2, None, s, None) for k, s in enumerate(["random", " Random ", "RANDOM", "top-retrieval bm25", None, "", "nonsense"] * 3)] + [(90, None, None, None, None, None, None, None), (91, 2, "f", "CAND_0000009", float("nan"), "r", "unknown", NOW)]
    write(spark, labels, "label_id bigint, run_id int, file_name string, candidate_id string, score double, rationale string, stratum string, labelled_at timestamp_ntz", folder, "label_results", empty)
    feats = [(1, f"CAND_{k:07d}", float(k), 1.0, None if k % 2 else 0.5) for k in range(12)] + [(1, "CAND_0000011", 11.0, 1.0, None), (None, "CAND_0000001", 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0), (3, "CAND_0000005", None, float("nan"), None)]
    write(spark, feats, "search_id bigint, candidate_id string, bm25_score float, sim_ideal_max float, behavioral_composite float", folder, "feature_rows", empty)
    docs = [(1, None, "en"), (2, "", "en"), (3, "   \n", "en"), (4, LONG, "en"), (5, LONG, None), (6, "<p>Short.</p>", "en"), (7, "a" * 5000, "en"), (8, "naïve café 日本 🙂 <|endoftext|>", "EN"), (9, "12 34 56. " * 40, "en"), (10, "same text", "en"), (11, "same text", "en")]
    write(spark, [(i, t, lang, None, None, None, None, None) for i, t, lang in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, account_code string, created_at timestamp_ntz, ingested_at timestamp_ntz", folder, "documents", empty)
    write(spark, [(1, "company", "Acorn Delta Systems"), (2, "current_title", "Data Engineer"), (3, "industry", "Banking")], "ref_id int, field_name string, label string", folder, "canonical_values", empty)
    write(spark, [("random", 0.9, 5), ("top_retrieval_bm25", 0.1, 2)], "stratum string, target_share double, min_rows int", folder, "stratum_targets", empty)
    write(spark, [(1, "We go up. I am in. He is at it.", 1), (2, "Institutional considerations necessitate comprehensive reorganisation of interdisciplinary departments", 4)], "sample_id int, text string, band int", folder, "graded_samples", empty)
    write(spark, [(1, "rerank_passage", 512), (2, "teacher_prompt", 2048)], "window_id int, window_name string, capacity_tokens int", folder, "context_windows", empty)


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    edge_tables(spark, folder, False)
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    edge_tables(spark, folder, True)
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)
