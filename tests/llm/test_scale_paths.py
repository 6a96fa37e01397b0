"""What only large inputs use: blocks, parts, tails of lists, groups of many links; and names in general."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillrank.llm import calibrated_sample, canonical, grouping, name_links, near_duplicates, reading_level
from quillrank.llm.tries import distance

SF = "/root/testdata/sf0.001"


def test_any_pair_within_the_bound_meets_in_a_shard():
    random.seed(5)
    met = 0
    for _ in range(20000):
        a = "".join(random.choice("abcdefgh") for _ in range(random.randrange(3, 18)))
        s = list(a)
        for _ in range(random.randrange(1, 4)):
            i, how = random.randrange(len(s)), random.choice("dciss")
            if how == "d" and len(s) > 1:
                del s[i]
            elif how == "c":
                s[i] = random.choice("xyz")
            elif how == "i":
                s.insert(i, random.choice("xyab"))
            elif i + 1 < len(s):
                s[i], s[i + 1] = s[i + 1], s[i]
        b, most = "".join(s), name_links.most_edits(max(len(a), len(s)))
        if distance(a, b, most) <= most:
            met += 1
            assert set(name_links.index_keys(a)) & name_links.query_keys(b) and set(name_links.index_keys(b)) & name_links.query_keys(a)
    assert met > 10000


def _linked(spark, names):
    df = spark.createDataFrame([("company", x, n) for x, n in names], "field_name string, name string, n bigint")
    return {r["name"]: r["organisation"] for r in name_links.linked_names(df).collect()}


def test_names_of_any_kind_and_order_meet(spark):
    pairs = [("Infosys", "Infosis"), ("Accenture", "Acenture"), ("Big Blue Airlines", "Big Blue Airlnies"), ("Delta Harbor Quiet Maple Systems", "Delta Quiet Harbor Maple Systems"), ("Alto Brisk Cedar Dune Ember Fjord Systems", "Ember Cedar Alto Fjrod Dune Brisk Systems")]
    got = _linked(spark, [(a, 5) for a, _ in pairs] + [(b, 1) for _, b in pairs])
    assert all(got[a] == got[b] for a, b in pairs) and len(set(got.values())) == len(pairs)


def test_a_very_long_name_is_one_name(spark):
    got = _linked(spark, [("word " * 900, 2), (" ".join(f"w{k:03d}" for k in range(200)), 1)])
    assert len(set(got.values())) == 2


@pytest.mark.parametrize("shape", ["chain", "hub", "random"])
def test_groups_of_many_links(spark, shape):
    random.seed(6)
    links = {"chain": [(k, k + 1) for k in range(400)], "hub": [(7, k) for k in range(500)], "random": [(random.randrange(600), random.randrange(600)) for _ in range(400)]}[shape]
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(6)
    assert rows(grouping.groups_of(df)) == sorted(((n, find(n)) for n in {x for link in links for x in link}), key=str)
    text = df.select(F.format_string("%05d", "a").alias("a"), F.format_string("%05d", "b").alias("b"))
    assert {(int(n), int(r)) for n, r in rows(grouping.groups_of(text))} == {(n, find(n)) for n in {x for link in links for x in link}}


def test_pairs_in_parts_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(grouping, "BLOCK", 3)
    members = [("g", f"m{k:02d}") for k in range(11)] + [("h", "x"), ("h", "y"), ("i", "z")]
    df = spark.createDataFrame(members, "grp string, item string")
    want = sorted([("g", a, b) for a, b in combinations([m for g, m in members if g == "g"], 2)] + [("h", "x", "y")], key=str)
    assert rows(grouping.pairs_within(df, ["grp"], "item")) == want
    asked = spark.createDataFrame([(1, "g"), (2, "h"), (3, "none")], "k int, ask string")
    assert rows(grouping.members_of(asked, "ask", df, "grp", "item", "got")) == sorted([(1, "g", m) for g, m in members if g == "g"] + [(2, "h", "x"), (2, "h", "y")], key=str)


def test_bands_in_parts_give_the_same_pairs(spark, monkeypatch):
    want = rows(near_duplicates.p5_found(spark, SF))
    monkeypatch.setattr(near_duplicates, "SAMPLED", 1)
    monkeypatch.setattr(near_duplicates, "PART", 2)
    assert rows(near_duplicates.p5_found(spark, SF)) == want and want


def test_rare_words_by_a_shuffle_give_the_same_levels(spark, monkeypatch):
    want = rows(reading_level.p10_found(spark, SF))
    monkeypatch.setattr(reading_level, "HEAD_WORDS", 50)
    assert rows(reading_level.p10_found(spark, SF)) == want and want
    plan = reading_level.p10_found(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_values_in_parts_give_the_same_matches(spark, monkeypatch):
    want = rows(canonical.p7_found(spark, SF))
    monkeypatch.setattr(canonical, "FEW_VALUES", 0)
    monkeypatch.setattr(canonical, "ROWS_OF_A_VALUE", 2)
    assert rows(canonical.p7_found(spark, SF)) == want and want


def test_values_of_any_field():
    cities = canonical.Reference("city", [(1, "New Delhi"), (2, "Bengaluru"), (3, "San Francisco"), (4, "Saint Petersburg")])
    assert [cities.match(x) for x in ("new  delhi", "Bengalaru", "San Fransisco", "Francisco, San", "Saint Petersbrg", "Pune")] == [1, 2, 3, 3, 4, 0]
    brands = canonical.Reference("brand", [(1, "Northwind Traders"), (2, "Blue Yonder"), (3, "Contoso")])
    assert [brands.match(x) for x in ("Northwnd Traders Ltd", "BlueYonder", "contosso", "Yonder Blue", "Red Yonder", "")] == [1, 2, 3, 2, 0, 0]


def test_targets_out_of_reach_are_those_of_the_dual():
    rng = np.random.default_rng(3)
    for _ in range(400):
        x = (rng.random((rng.integers(2, 12), rng.integers(2, 6))) < 0.4).astype(float)
        x = x[x.any(axis=1)]
        if len(x):
            units, want = rng.integers(1, 60, len(x)).astype(float), rng.integers(0, 60, x.shape[1]).astype(float)
            moment = (calibrated_sample.tilt(x, units, want) * units) @ x
            assert not ((units @ x < want) & (moment >= want - 1e-3)).any()


def test_blocks_of_a_run_hold_a_bounded_number_of_units(spark):
    """Group sizes at twenty million units, counted and not run: a third of them in one run and mask."""
    units = spark.range(20_000_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1)).cast("int").alias("run_id"), F.col("id").cast("string").alias("candidate_id"), F.lit("0").alias("mask"))
    plan = units.groupBy("run_id", "mask").agg(F.count(F.lit(1)).alias("n_units")).withColumn("n_drawn", F.lit(100))
    sizes = calibrated_sample.salted(units, plan).groupBy("run_id", "_salt").count()
    top = sizes.agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("k"), F.min("count").alias("l")).head()
    assert top["m"] < 1.1 * calibrated_sample.BLOCK_UNITS and top["l"] > 1000 and top["k"] < 6000
