"""Null, empty, repeated, very long and clashing input through every query of the subpackage."""

import pytest

from conftest import rows
from quillrank.llm.registry import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert rows(QUERIES[name](spark, empty_dir)) == []


EXPECTED = {
    "p3_found": lambda r: r == [("company", "Acorn Delta Systems", "Acorn Delta Systms")],
    "p4_found": lambda r: r == [(1, "random"), (1, "top_retrieval_bm25"), (2, "random"), (2, "top_retrieval_bm25")],
    "p4_sample": lambda r: {x[:2] for x in r} == {(1, f"CAND_{k:07d}") for k in range(4)},
    "p5_found": lambda r: r == [("CAND_0000003", "CAND_0000004")],
    "p6_found": lambda r: len(r) == 11 and {x[1] for x in r if x[0] == 1} == {f"CAND_{k:07d}" for k in range(12) if k not in (1, 3)},
    "p7_found": lambda r: set(r) == {(6, "company", 1, 1), (6, "current_title", 0, 2)},
    "p8_ids": lambda r: len(r) == 11 and {x[0] for x in r if not x[1]} == {1, 2},
    "p9_found": lambda r: {x[0] for x in r} == {4, 5},
    "p10_found": lambda r: {x[0] for x in r} == {4, 7},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_tables(spark, edge_dir, name):
    got = rows(QUERIES[name](spark, edge_dir))
    assert EXPECTED.get(name, lambda r: True)(got), got[:20]
