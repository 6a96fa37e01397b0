"""The labelling sample beyond twenty a stratum."""

from collections import Counter

import duckdb

from quillrank.functions import config as C
from quillrank.plans.labels import QUERIES, STRATA

SF = "/root/testdata/sf0.1"


def test_each_stratum_gives_its_own_quota(spark):
    query, sql = QUERIES["stratified_sample"]
    got = [tuple(r) for r in query(spark, SF).select("candidate_id", "stratum").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW label_results AS SELECT * FROM '{SF}/label_results.parquet'")
    assert sorted(got) == sorted(con.execute(sql).fetchall())
    assert list(C.QUOTAS) == STRATA and sum(C.QUOTAS.values()) == 2500
    by = Counter(s for _, s in got)
    assert all(20 < by[s] <= n for s, n in C.QUOTAS.items()) and len({c for c, _ in got}) == len(got)
