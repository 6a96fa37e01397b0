"""Retrieval beyond the first hundred."""

import duckdb
import numpy as np

from quillrank.operators import vectors
from quillrank.plans.search import QUERIES

SF = "/root/testdata/sf0.1"


def duck(name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(QUERIES[name][1]).fetchall()


def test_a_rank_below_the_hundredth_still_counts(spark):
    got = {r["doc"]: (r["rank"], r["rrf"]) for r in QUERIES["hybrid_candidates"][0](spark, SF).select("doc", "rank", "rrf").collect()}
    assert len(got) == 2000
    assert got == {doc: (rank, rrf) for doc, rrf, rank in duck("hybrid_candidates")}
    ranks = [{doc: rank for doc, rank in duck(name)} for name in ("bm25_retrieved", "dense_retrieved")]
    assert list(map(len, ranks)) == [5000, 2000]
    assert any(min(r.get(doc, 9999) for r in ranks) > 100 for doc in got)


def test_every_hundredth_row_is_a_query(spark):
    got = {(r["qid"], r["rank"]): (r["vec_id"], r["score"]) for r in QUERIES["dense_neighbours"][0](spark, SF).collect()}
    assert len(got) == 2000 and {q for q, _ in got} == set(range(0, 2000, 100))
    assert got == {(qid, rank): (vec_id, score) for qid, vec_id, score, rank in duck("dense_neighbours")}


def test_more_queries_than_a_block(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(5000, 4)), 1)
    x[:300] = x[300:600]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i bigint, v array<double>").repartition(3)
    got = vectors.nearest(df, df.where("i < 300").withColumnRenamed("i", "q"), "i", "v", "q", 7, block=128).collect()
    unit = x / (np.sqrt((x * x).sum(axis=1)) + vectors.NORM_EPSILON)[:, None]
    cos = np.round(unit[:300] @ unit.T, 9)
    assert {(r["q"], r["rank"], r["i"]) for r in got} == {(q, k + 1, i) for q in range(300) for k, i in enumerate(np.lexsort((np.arange(5000), -cos[q]))[:7])}
    assert vectors.nearest(df, df.where("i < 0").withColumnRenamed("i", "q"), "i", "v", "q", 7).count() == 0
