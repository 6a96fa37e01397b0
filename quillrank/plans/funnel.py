"""From candidates to a ranking: retrieval over candidates, fusion, all 48 features, model, rerank, final order; strata pools.

The latest delivery of each candidate stands for it. Scores of a candidate are expressions over its own row (the
lexical weights and the query vectors are fixed values by then); what is shuffled are ids and scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions import config as C
from quillrank.functions.tables import checkpoint, kept, table
from quillrank.operators import bm25, consistency, embedding, features, model, ranking
from quillrank.operators.text import any_contains, career_text, chunks, entries, index_text
from quillrank.plans import records, scoring
from quillrank.plans.labels import _drawn, _quota_sql

TEXTS = C.WANTED_TEXTS + C.UNWANTED_TEXTS
QUERY = C.WANTED_TEXTS[0]
RETRIEVED, CANDIDATES = 5000, 2000


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each candidate, whole; only ids and times meet in the aggregate."""
    c = table(spark, sf_dir, "candidates")
    last = c.where("candidate_id is not null").groupBy("candidate_id").agg(F.max(F.struct("received_at", "record_id"))["record_id"].alias("record_id"))
    return c.join(last.select("record_id"), "record_id", "left_semi")


def _scored(rows: DataFrame, stats: bm25.Corpus | None = None) -> DataFrame:
    """(record_id, candidate_id, bm25_score, semantic struct)."""
    texts = rows.withColumn("_text", index_text())
    stats = stats or bm25.corpus(texts, "_text")
    return texts.select("record_id", "candidate_id", F.round(bm25.score("_text", stats, QUERY), 9).alias("bm25_score"), embedding.semantic(chunks(), TEXTS, len(C.WANTED_TEXTS)).alias("_s"))


def _retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(latest(spark, sf_dir))
    return kept(scored.select("record_id", "candidate_id", "bm25_score", F.round("_s.dense_score", 9).alias("dense_score"), F.round("_s.anti_score", 9).alias("anti_score")))


def candidate_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(_retrieval(spark, sf_dir).select("record_id", "bm25_score"), RETRIEVED, F.desc("bm25_score"), "record_id").select("record_id", "rank")


def candidate_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieval(spark, sf_dir).select("record_id", F.round("dense_score", 6).alias("dense_score"), F.round("anti_score", 6).alias("anti_score"))


def _fused(scored: DataFrame) -> DataFrame:
    lists = [ranking.top_k(scored.select("record_id", c), RETRIEVED, F.desc(c), "record_id") for c in ("bm25_score", "_dense")]
    fused = ranking.fuse(lists, "record_id")
    return ranking.top_k(fused.select("record_id", F.round("rrf", 9).alias("rrf")), CANDIDATES, F.desc("rrf"), "record_id")


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Six places decide the order, as sums of products differ in the last ones.
    scored = _retrieval(spark, sf_dir).withColumns({"_dense": F.round("dense_score", 6)})
    return scored, kept(_fused(scored))


def candidate_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir)[1]


def _features(rows: DataFrame, shares: DataFrame, stats: bm25.Corpus) -> DataFrame:
    """record_id, candidate_id and the 48 columns in their order; ``shares`` has each record's place in the whole corpus."""
    prepared = rows.withColumns({"_career_text": career_text(), "_findings": consistency.findings(), "_text": index_text(), "_chunks": chunks()})
    own = {k: v.cast("double") for group in features.GROUPS for k, v in group().items()}
    lexical = F.round(bm25.score("_text", stats, QUERY), 9)
    made = prepared.select("record_id", "candidate_id", embedding.semantic(F.col("_chunks"), TEXTS, len(C.WANTED_TEXTS)).alias("_s"), lexical.alias("bm25_score"), *(v.alias(k) for k, v in own.items()))
    made = made.select("record_id", "candidate_id", *(F.col(f"_s.{k}").alias(k) for k in embedding.SEMANTIC), *(c for c in made.columns if c not in ("record_id", "candidate_id", "_s")))
    return made.join(shares, "record_id").select("record_id", "candidate_id", *(F.round(k, 6).alias(k) for k in scoring.FEATURES))


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bm25.Corpus, DataFrame]:
    rows = latest(spark, sf_dir)
    texts = rows.select("record_id", index_text().alias("_text"))
    stats = bm25.corpus(texts, "_text")
    lexical = kept(texts.select("record_id", F.round(bm25.score("_text", stats, QUERY), 9).alias("s")))
    return rows, stats, ranking.share_at_most(lexical, "record_id", "s").withColumnRenamed("share", "bm25_rank_pct")


def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 48 features of every candidate."""
    rows, stats, shares = _corpus(spark, sf_dir)
    return _features(rows, shares, stats).drop("candidate_id")


def _final(pool: DataFrame, score: str) -> DataFrame:
    """The first hundred plausible rows of a pool in the order of ``place``, scores brought to 0 to 1, ties by id."""
    first = pool.where("not _implausible").orderBy("place").limit(C.FINAL)
    whole = W.partitionBy()  # a hundred rows
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    out = first.select("candidate_id", F.bround(F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0), 6).alias("score"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "candidate_id")))


def candidate_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval to final order without the model: the fused score orders, the head of 200 keeps its order as the
    fallback of a reranker does, implausible records go, a hundred are left."""
    _, fused = _retrieved(spark, sf_dir)
    rows = latest(spark, sf_dir).join(F.broadcast(fused.select("record_id", "rrf")), "record_id")  # at most CANDIDATES rows
    flagged = rows.select("record_id", "candidate_id", "rrf", consistency.is_implausible(consistency.findings()).alias("_implausible"))
    return _final(ranking.reranked(flagged, [], "record_id", "rrf", C.RERANKED), "order_score")


def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole funnel: retrieved candidates with all features, scored by the trained model, reranked, final order,
    and the two features that lower each score most."""
    _, fused = _retrieved(spark, sf_dir)
    rows, stats, shares = _corpus(spark, sf_dir)
    few = F.broadcast(fused.select("record_id"))  # at most CANDIDATES rows
    made = kept(_features(rows.join(few, "record_id", "left_semi"), shares.join(few, "record_id", "left_semi"), stats))
    booster = scoring.trained(spark, sf_dir)
    scored = model.predict(booster, made, scoring.FEATURES).withColumn("_implausible", F.col("is_honeypot") > 0)
    final = _final(ranking.reranked(scored.select("record_id", "candidate_id", "score", "_implausible"), [], "record_id", "score", C.RERANKED), "order_score")
    parts = model.contributions(booster, made.join(F.broadcast(final.select("candidate_id")), "candidate_id", "left_semi"), scoring.FEATURES, "candidate_id")
    low = model.most_negative(F.col("contributions"), scoring.FEATURES)
    return final.join(parts.select("candidate_id", F.array_join(low["feature"], ",").alias("lowered_by")), "candidate_id").select("candidate_id", "rank", "score", "lowered_by")


def reranked_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search's rows: the first fifty by the fallback of the reranker, then the rest by their own score."""
    rows = scoring._rows(spark, sf_dir).select("search_id", "candidate_id", F.round(F.col("sim_ideal_max").cast("double"), 6).alias("s"))
    return ranking.reranked(rows, ["search_id"], "candidate_id", "s", 50).select("search_id", "candidate_id", "order_score", "place")


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(spark, sf_dir)
    jobs = entries("career_history")
    s = lambda k: F.coalesce(F.col(f"redrob_signals.{k}"), F.lit(0.0))
    title = F.lower(F.coalesce("profile.current_title", F.lit("")))
    flags = rows.select(
        "record_id", any_contains(title, C.TITLE_WORDS).alias("titled"), F.forall(jobs, lambda j: any_contains(F.lower(F.coalesce(j["company"], F.lit(""))), C.IT_SERVICES)).alias("consulting"),
        consistency.is_implausible(consistency.findings()).alias("implausible"), F.exists(entries("education"), lambda e: F.coalesce(e["tier"] == "tier_1", F.lit(False))).alias("tier1"),
        F.round(s("recruiter_response_rate") + s("interview_completion_rate"), 6).alias("behaviour"),
    )
    both = kept(_retrieval(spark, sf_dir).select("record_id", "candidate_id", F.round("bm25_score", 6).alias("lexical"), F.round("dense_score", 6).alias("dense"), F.round("anti_score", 6).alias("anti")).join(flags, "record_id"))
    top = C.POOL_TOP
    cut = {
        "top_retrieval_bm25": both.orderBy(F.desc("lexical"), "record_id"), "top_retrieval_dense": both.orderBy(F.desc("dense"), "record_id"), "top_anti_persona_sim": both.orderBy(F.desc("anti"), "record_id"),
        "high_behavioral": both.orderBy(F.desc("behaviour"), "record_id"), "low_behavioral": both.orderBy("behaviour", F.desc("record_id")),
    }
    pools = {k: v.limit(top[k]) for k, v in cut.items()}
    pools |= {
        "title_match_strong": both.where("titled"), "title_mismatch": both.where((~F.col("titled")) & (F.col("dense") > C.MISMATCH_FROM)), "consulting_only": both.where("consulting"),
        "honeypot_flagged": both.where("implausible"), "tier1_education": both.where("tier1"), "random": both,
    }
    return reduce(DataFrame.unionByName, (pools[k].select("candidate_id", F.lit(k).alias("stratum")) for k in C.QUOTAS))


def strata_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is in which of the eleven pools; a candidate can be in several."""
    return _pools(spark, sf_dir)


def pool_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelling sample drawn from the pools, in their order, each candidate once."""
    return _drawn(checkpoint(_pools(spark, sf_dir)), C.QUOTAS)


def _vectors_sql() -> str:
    q = embedding._unit(embedding.hashed_vectors(TEXTS))
    return ", ".join(f"({i}, {d}, {q[i, d]!r}::DOUBLE)" for i in range(len(q)) for d in range(embedding.DIM) if q[i, d]).replace("np.float64(", "").replace(")::", "::")


_LATEST = "latest AS (SELECT arg_max(record_id, (received_at, record_id)) AS record_id FROM candidates WHERE candidate_id IS NOT NULL GROUP BY candidate_id), own AS (SELECT * FROM candidates WHERE record_id IN (SELECT record_id FROM latest))"
_SEM = f"""every AS ({records.CHUNKS_EVERY}),
words AS (SELECT record_id, o, md5(unnest(regexp_extract_all(lower(t), '[a-z0-9]+'))) AS h FROM every),
vec AS (SELECT record_id, o, CAST('0x' || substr(h, 1, 2) AS INT) % {embedding.DIM} AS d, sum(CASE WHEN CAST('0x' || substr(h, 3, 1) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS x FROM words GROUP BY 1, 2, 3),
size AS (SELECT record_id, o, sqrt(sum(x * x)) AS n FROM vec GROUP BY 1, 2),
unit AS (SELECT record_id, o, d, x / n AS x FROM vec JOIN size USING (record_id, o) WHERE n > 0),
q AS (SELECT * FROM (VALUES {_vectors_sql()}) AS v(qid, d, x)),
dots AS (SELECT record_id, o, qid, sum(unit.x * q.x) / (1 + 1e-9) AS cos FROM unit JOIN q USING (d) GROUP BY 1, 2, 3),
grid AS (SELECT e.record_id, e.o, k.qid, coalesce(cos, 0) AS cos FROM every AS e CROSS JOIN (SELECT DISTINCT qid FROM q) AS k LEFT JOIN dots ON dots.record_id = e.record_id AND dots.o = e.o AND dots.qid = k.qid),
near AS (SELECT record_id, max(cos) FILTER (qid < 5) AS a, avg(cos) FILTER (qid < 5) AS b, max(cos) FILTER (qid >= 5) AS c, max(cos) FILTER (qid = 0) AS s FROM grid GROUP BY 1),
cover AS (SELECT record_id, avg(m) AS m, min(m) AS l, stddev_pop(m) AS d FROM (SELECT record_id, qid, max(cos) AS m FROM grid WHERE qid >= 4 GROUP BY 1, 2) GROUP BY 1),
times AS (SELECT record_id, count(*) AS k FROM every GROUP BY 1),
pool AS (SELECT record_id, d, sum(x) / any_value(k) AS x FROM unit JOIN times USING (record_id) GROUP BY 1, 2),
psize AS (SELECT record_id, sqrt(sum(x * x)) + 1e-9 AS n FROM pool GROUP BY 1),
pdots AS (SELECT record_id, qid, sum(pool.x * q.x) / any_value(n) AS cos FROM pool JOIN psize USING (record_id) JOIN q USING (d) GROUP BY 1, 2),
pgrid AS (SELECT t.record_id, k.qid, coalesce(cos, 0) AS cos FROM times AS t CROSS JOIN (SELECT DISTINCT qid FROM q) AS k LEFT JOIN pdots ON pdots.record_id = t.record_id AND pdots.qid = k.qid),
dense AS (SELECT record_id, max(cos) FILTER (qid < 5) AS dense_score, max(cos) FILTER (qid >= 5) AS anti_score FROM pgrid GROUP BY 1),
sem AS (SELECT record_id, round(a, 6) AS sim_ideal_max, round(b, 6) AS sim_ideal_mean, round(c, 6) AS sim_anti_max, round(a - 0.4 * c, 6) AS semantic_contrastive, round(s, 6) AS sim_jd_summary, round(m, 6) AS per_req_coverage_mean, round(l, 6) AS per_req_coverage_min, round(d, 6) AS per_req_coverage_std
  FROM near JOIN cover USING (record_id))"""
_BM = f"""tok AS (SELECT record_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM itext),
lens AS (SELECT doc, coalesce(len(t), 0) AS length FROM tok),
posts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM tok) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
raw AS (SELECT term, ln((SELECT count(*) FROM lens) - df + 0.5) - ln(df + 0.5) AS r FROM dfs),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
query AS (SELECT unnest({bm25.query_words(QUERY)}) AS term),
hit AS (
  SELECT p.doc, sum(idf.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.length / (SELECT avg(length) FROM lens)))) AS s
  FROM query AS q JOIN posts AS p USING (term) JOIN idf USING (term) JOIN lens AS l ON l.doc = p.doc GROUP BY 1),
bm AS (SELECT lens.doc AS record_id, round(coalesce(s, 0), 9) AS bm25_score FROM lens LEFT JOIN hit ON hit.doc = lens.doc)"""
_RETRIEVE = f"WITH {records._JOBS.replace('FROM candidates', 'FROM own').replace('jobs AS', _LATEST + ', jobs AS', 1)}, {records._ITEXT.format(source='own')}, {_SEM.replace('FROM candidates', 'FROM own')}, {_BM}"
_HYBRID = f"""{_RETRIEVE},
lex AS (SELECT record_id, row_number() OVER (ORDER BY bm25_score DESC, record_id) AS rank FROM bm QUALIFY rank <= {RETRIEVED}),
den AS (SELECT record_id, row_number() OVER (ORDER BY round(dense_score, 6) DESC, record_id) AS rank FROM dense QUALIFY rank <= {RETRIEVED}),
f AS (SELECT record_id, round(sum(1 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY 1),
fused AS (SELECT record_id, rrf, row_number() OVER (ORDER BY rrf DESC, record_id) AS rank FROM f QUALIFY rank <= {CANDIDATES})"""
_FLAGGED = f"rolled AS ({records.ROLLUP_SQL})"
_POOLS = f"""{_RETRIEVE}, {_FLAGGED},
every_one AS (SELECT c.record_id, c.candidate_id, round(bm25_score, 6) AS lexical, round(dense_score, 6) AS dense, round(anti_score, 6) AS unwanted, r.is_implausible = 1 AS implausible,
  {records._any("lower(coalesce(c.profile.current_title, ''))", C.TITLE_WORDS)} AS titled, coalesce((SELECT bool_and({records._any("lower(coalesce(j.company, ''))", C.IT_SERVICES)}) FROM jobs WHERE jobs.record_id = c.record_id), true) AS consulting,
  len(list_filter(coalesce(c.education, []), lambda e: e.tier = 'tier_1')) > 0 AS tier1, round(coalesce(c.redrob_signals.recruiter_response_rate, 0) + coalesce(c.redrob_signals.interview_completion_rate, 0), 6) AS behaviour
  FROM own AS c JOIN bm ON bm.record_id = c.record_id JOIN dense ON dense.record_id = c.record_id JOIN rolled AS r ON r.record_id = c.record_id),
pools AS (
  SELECT candidate_id, 'top_retrieval_bm25' AS stratum FROM (SELECT * FROM every_one ORDER BY lexical DESC, record_id LIMIT 500)
  UNION ALL SELECT candidate_id, 'top_retrieval_dense' FROM (SELECT * FROM every_one ORDER BY dense DESC, record_id LIMIT 500)
  UNION ALL SELECT candidate_id, 'top_anti_persona_sim' FROM (SELECT * FROM every_one ORDER BY unwanted DESC, record_id LIMIT 300)
  UNION ALL SELECT candidate_id, 'high_behavioral' FROM (SELECT * FROM every_one ORDER BY behaviour DESC, record_id LIMIT 300)
  UNION ALL SELECT candidate_id, 'low_behavioral' FROM (SELECT * FROM every_one ORDER BY behaviour, record_id DESC LIMIT 300)
  UNION ALL SELECT candidate_id, 'title_match_strong' FROM every_one WHERE titled
  UNION ALL SELECT candidate_id, 'title_mismatch' FROM every_one WHERE NOT titled AND dense > 0.3
  UNION ALL SELECT candidate_id, 'consulting_only' FROM every_one WHERE consulting
  UNION ALL SELECT candidate_id, 'honeypot_flagged' FROM every_one WHERE implausible
  UNION ALL SELECT candidate_id, 'tier1_education' FROM every_one WHERE tier1
  UNION ALL SELECT candidate_id, 'random' FROM every_one)"""
FEATURES_SQL = f"""{_RETRIEVE},
{_FLAGGED}, f1 AS ({records.SKILL_SQL}), f2 AS ({records.CAREER_SQL}), f3 AS ({records.EDUCATION_SQL}), f4 AS ({records.LOGISTICS_SQL}), f5 AS ({records.BEHAVIOUR_SQL}),
b AS (SELECT record_id, bm25_score, cume_dist() OVER (ORDER BY bm25_score) AS p FROM bm)
SELECT f1.record_id, sem.* EXCLUDE (record_id), round(b.bm25_score, 6) AS bm25_score, round(b.p, 6) AS bm25_rank_pct, f1.* EXCLUDE (record_id), f2.* EXCLUDE (record_id), f3.* EXCLUDE (record_id), f4.* EXCLUDE (record_id), f5.* EXCLUDE (record_id),
  CAST(r.n_findings AS DOUBLE) AS consistency_violation_count, CAST(r.is_implausible AS DOUBLE) AS is_honeypot
FROM f1 JOIN f2 USING (record_id) JOIN f3 USING (record_id) JOIN f4 USING (record_id) JOIN f5 USING (record_id) JOIN rolled AS r USING (record_id) JOIN sem USING (record_id) JOIN b USING (record_id)
"""
SHORTLIST_SQL = f"""{_HYBRID}, {_FLAGGED},
placed AS (SELECT fused.*, c.candidate_id, r.is_implausible, CASE WHEN rank <= {C.RERANKED} THEN {C.RERANKED} - rank + 1 ELSE rrf END AS s FROM fused JOIN own AS c USING (record_id) JOIN rolled AS r USING (record_id)),
first AS (SELECT * FROM placed WHERE is_implausible = 0 ORDER BY rank <= {C.RERANKED} DESC, s DESC, record_id LIMIT {C.FINAL}),
out AS (SELECT candidate_id, round_even(CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 1 END, 6) AS score FROM first)
SELECT candidate_id, score, CAST(row_number() OVER (ORDER BY score DESC, candidate_id) AS INT) AS rank FROM out
"""
RERANKED_SQL = """
WITH r AS (SELECT DISTINCT ON (search_id, candidate_id) * FROM feature_rows WHERE search_id IS NOT NULL AND candidate_id IS NOT NULL),
k AS (SELECT search_id, candidate_id, round(CAST(sim_ideal_max AS DOUBLE), 6) AS s FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY s DESC NULLS LAST, candidate_id) AS k FROM k),
o AS (SELECT *, CASE WHEN k <= 50 THEN CAST(50 - k + 1 AS DOUBLE) ELSE s END AS order_score FROM n)
SELECT search_id, candidate_id, order_score, CAST(row_number() OVER (PARTITION BY search_id ORDER BY k <= 50 DESC, order_score DESC NULLS LAST, candidate_id) AS INT) AS place FROM o
"""
QUERIES = {
    "candidate_bm25": (candidate_bm25, _HYBRID + " SELECT record_id, CAST(rank AS INT) AS rank FROM lex"),
    "candidate_dense": (candidate_dense, _RETRIEVE + " SELECT record_id, round(dense_score, 6) AS dense_score, round(anti_score, 6) AS anti_score FROM dense"),
    "candidate_hybrid": (candidate_hybrid, _HYBRID + " SELECT record_id, rrf, CAST(rank AS INT) AS rank FROM fused"),
    "candidate_features": (candidate_features, FEATURES_SQL),
    "candidate_shortlist": (candidate_shortlist, SHORTLIST_SQL),
    "candidate_ranking": (candidate_ranking, None),
    "reranked_searches": (reranked_searches, RERANKED_SQL),
    "strata_pools": (strata_pools, _POOLS + " SELECT * FROM pools"),
    "pool_sample": (pool_sample, _quota_sql(C.QUOTAS, _POOLS + ", u AS MATERIALIZED (SELECT * FROM pools)")),
}
