"""Names without a kind word."""

from quillrank.llm import name_links


def test_spellings_without_a_kind_meet(spark):
    names = [("Infosys", 9), ("Infosyss", 1), ("Luowen Beacon", 8), ("Luowen Becon", 1), ("Beacon Luowen", 1), ("Zentrava", 7)]
    df = spark.createDataFrame([("company", x, n) for x, n in names], "field_name string, name string, n bigint")
    got = {r["name"]: r["organisation"] for r in name_links.linked_names(df).collect()}
    assert got["Infosys"] == got["Infosyss"] and got["Luowen Beacon"] == got["Luowen Becon"] == got["Beacon Luowen"]
    assert len(set(got.values())) == 3


def test_a_neighbour_with_a_kind_comes_first(spark):
    names = [("Luowen Beacon Systems", 8), ("Luowen Becan", 1), ("Luowen Becon", 5)]
    df = spark.createDataFrame([("company", x, n) for x, n in names], "field_name string, name string, n bigint")
    got = {r["name"]: r["organisation"] for r in name_links.linked_names(df).collect()}
    assert len(set(got.values())) == 1
