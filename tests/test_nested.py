import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from quillrank.operators.shredding import assemble, leaves, shred
from quillrank.plans.nested_tables import p1_found
from quillrank.sources.payloads import normalise_payload


def test_edge_records(spark, edge_dir):
    got = set(rows(p1_found(spark, edge_dir)))
    assert {(1, "career_history", 0, "Acorn Delta Systems"), (1, "career_history", 2, ""), (2, "skills", 0, "Python"), (5, "skill_assessment_scores", -1, "SQL"), (5, "redrob_signals", 0, ""), (6, "career_history", 1, "Acorn Delta Systms")} <= got
    assert (1, "career_history", 1, "") not in got and (6, "career_history", 0, "") not in got and (6, "education", 0, "") not in got
    assert {(100, "skills", 0, "a"), (100, "skills", 1, "b"), (100, "skills", 3, "c"), (101, "education", 0, "X")} <= got
    assert not [r for r in got if r[0] in (3, 4) or r[0] > 101]


def test_empty_tables(spark, empty_dir):
    assert rows(p1_found(spark, empty_dir)) == []


def test_levels_of_lists_in_lists(spark):
    df = spark.createDataFrame([(1, [([1, 2], "a"), None, ([], "b")]), (2, []), (3, None)], "id int, xs array<struct<ys:array<int>,t:string>>")
    levels, found = shred(df, ["xs"], ["id"])
    assert [x.path for x in found] == ["xs.ys", "xs.t"]
    first = levels.where("id = 1").select("`xs.ys`").head()[0]
    assert [(e["r"], e["d"], e["v"]) for e in first] == [(0, 6, 1), (2, 6, 2), (1, 2, None), (1, 4, None)]
    assert rows(assemble(levels, found, "xs", ["id"])) == [(1, 0, "a"), (1, 1, None), (1, 2, "b")]
    assert rows(assemble(levels, found, "xs.ys", ["id"])) == [(1, 0, 1), (1, 1, 2)]
    assert [r["d"] for i in (2, 3) for r in levels.where(f"id = {i}").select("`xs.t`").head()[0]] == [1, 0]


def test_leaves_of_a_map(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (2, None)], "id int, m map<string,int>")
    assert [x.path for x in leaves(df.schema["m"].dataType, "m")] == ["m.key", "m.value"]
    levels, found = shred(df, ["m"], ["id"])
    assert rows(assemble(levels, found, "m", ["id"])) == [(1, 0, "a", 1)]


def test_round_trip_on_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/candidates.parquet").select("record_id", "skills")
    levels, found = shred(df, ["skills"], ["record_id"])
    back = assemble(levels, found, "skills", ["record_id"])
    plain = df.select("record_id", F.posexplode("skills").alias("item_no", "s")).select("record_id", "item_no", *(F.col(f"s.{x.path.split('.')[1]}") for x in found))
    assert back.exceptAll(plain).count() == 0 and plain.exceptAll(back).count() == 0


ENTRY = st.none() | st.fixed_dictionaries({"name": st.none() | st.sampled_from(["a", "b c", ""]), "endorsements": st.none() | st.integers(0, 9)})


@settings(max_examples=60, deadline=None)
@given(st.lists(ENTRY, max_size=5), st.sampled_from(["plain", "numbered", "items", "text", "parts", "wrapped", "data", "list", "quoted"]))
def test_every_way_to_write_a_list_is_the_same(entries, way):
    value = entries
    if way == "numbered":
        value = {str(k): e for k, e in enumerate(entries)}
    elif way == "items":
        value = {"items": entries, "total": len(entries)}
    elif way == "text":
        value = json.dumps(entries)
    elif way == "parts":
        value = [entries[:2], entries[2:]]
    record = {"candidate_id": "C", "skills": value}
    whole = {"wrapped": {"candidate": record}, "data": {"data": {"kind": "p", "attributes": record}}, "list": [record], "quoted": json.dumps(record)}.get(way, record)
    got = normalise_payload(json.dumps(whole))["skills"]
    want = [None if e is None else {"name": e["name"], "proficiency": None, "endorsements": None if e["endorsements"] is None else str(e["endorsements"]), "duration_months": None} for e in entries]
    assert got == want
