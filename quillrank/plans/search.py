"""Queries over documents and embeddings: lexical and dense retrieval, fusion, text units."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import config as C
from quillrank.functions.tables import kept, shared_folder, table
from quillrank.operators import bm25, ranking, vectors
from quillrank.operators.text import tokenize

#: Stated queries of the embeddings table: the first five vectors are wanted, the next five unwanted.
WANTED, UNWANTED = range(0, 5), range(5, 10)
TOP_LIST, TOP_FUSED = 100, 50
#: Lengths of the reference's retrieval: of either list, and of the fused one.
RETRIEVED, CANDIDATES = 5000, 2000


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select("doc_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(_docs(spark, sf_dir), "doc_id", "text", C.QUERY).select("doc", F.round("score", 6).alias("score"))


def _lexical(spark: SparkSession, sf_dir: str, k: int = TOP_LIST) -> DataFrame:
    scored = bm25.scores(_docs(spark, sf_dir), "doc_id", "text", C.QUERY).select("doc", F.round("score", 9).alias("score"))
    return ranking.top_k(scored, k, F.desc("score"), "doc")


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("doc", "rank")


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores from an index kept in the shared folder: written at the first call over these tables, then attached."""
    docs = _docs(spark, sf_dir)
    index = bm25.index_of(docs, "doc_id", "text", f"{shared_folder(spark)}/index/{md5(sf_dir.encode()).hexdigest()}", sf_dir)
    return index.scores(" ".join(C.QUERY)).select("doc", F.round("score", 6).alias("score"))


def bm25_rank_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Scored once and kept: shares use the scores three times.
    scored = kept(bm25.scores(_docs(spark, sf_dir), "doc_id", "text", C.QUERY))
    shares = ranking.share_at_most(scored, "doc", "score")
    return shares.select("doc", F.round("share", 9).alias("share"))


def _cosines(spark: SparkSession, sf_dir: str, ids: range) -> DataFrame:
    v = _embeddings(spark, sf_dir)
    queries = v.where(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("qid"), F.col("embedding"))
    return vectors.cosines(v, queries.withColumnRenamed("embedding", "vec").select("qid", F.col("vec").alias("embedding")), "vec_id", "embedding", "qid")


def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector: best and mean likeness to wanted, best to unwanted, their contrast, coverage statistics."""
    cos = _cosines(spark, sf_dir, range(0, 10))
    of = lambda test: F.transform(F.filter("cosines", lambda x: test(x["qid"])), lambda x: x["cos"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    want, six = of(lambda q: q.isin(*WANTED)), of(lambda q: q >= 4)
    away = F.transform(six, lambda x: F.pow(x - mean(six), 2))
    out = cos.select("vec_id", F.array_max(want).alias("best"), mean(want).alias("mean"), F.array_max(of(lambda q: q.isin(*UNWANTED))).alias("worst"), F.array_max(of(lambda q: q == 0)).alias("first"), mean(six).alias("cover_mean"), F.array_min(six).alias("cover_min"), F.sqrt(mean(away)).alias("cover_std"))
    out = out.withColumn("contrast", F.col("best") - 0.4 * F.col("worst"))
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in ("best", "mean", "worst", "first", "contrast", "cover_mean", "cover_min", "cover_std")))


def mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = vectors.mean_pool(_embeddings(spark, sf_dir), "label", "embedding")
    return pooled.select("label", F.posexplode("mean").alias("place", "mean")).select("label", "place", F.round("mean", 6).alias("mean"))


def likeness_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second form of the cosine, of each vector with the one of id 0; no rows where there is none."""
    v = _embeddings(spark, sf_dir)
    first = v.where("vec_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    return v.join(F.broadcast(first)).select("vec_id", F.round(vectors.cosine_product_epsilon(F.col("embedding"), F.col("_q")), 6).alias("cos"))


def _dense(spark: SparkSession, sf_dir: str, k: int = TOP_LIST) -> DataFrame:
    best = _cosines(spark, sf_dir, WANTED).select("vec_id", F.round(F.array_max(F.col("cosines.cos")), 9).alias("score"))
    return ranking.top_k(best, k, F.desc("score"), "vec_id")


def dense_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("vec_id", "rank")


def _fused(spark: SparkSession, sf_dir: str, each: int, k: int) -> DataFrame:
    fused = ranking.fuse([_lexical(spark, sf_dir, each), _dense(spark, sf_dir, each).withColumnRenamed("vec_id", "doc")], "doc")
    return ranking.top_k(fused.select("doc", F.round("rrf", 9).alias("rrf")), k, F.desc("rrf"), "doc")


def hybrid_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lexical and dense top lists fused by reciprocal ranks."""
    return _fused(spark, sf_dir, TOP_LIST, TOP_FUSED)


def bm25_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, RETRIEVED).select("doc", "rank")


def dense_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, RETRIEVED).select("vec_id", "rank")


def dense_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every query, which is each row whose id is divisible by 100; itself among them."""
    v = _embeddings(spark, sf_dir)
    queries = v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.nearest(v, queries, "vec_id", "embedding", "qid", TOP_LIST)


def hybrid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's retrieval: lists as long as it takes them, so that a low rank in one still counts."""
    return _fused(spark, sf_dir, RETRIEVED, CANDIDATES)


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that hold something, numbered; one empty unit for a text without any."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    units = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(units).alias("pos", "line")).select("doc_id", "pos", F.md5("line").alias("line_md5"))


def documents_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.countDistinct("account_code").alias("n_accounts"))


_TERMS = f"""
WITH tok AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
lens AS (SELECT doc, coalesce(len(t), 0) AS length FROM tok),
posts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM tok) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
raw AS (SELECT term, ln((SELECT count(*) FROM lens) - df + 0.5) - ln(df + 0.5) AS r FROM dfs),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
query AS (SELECT unnest({C.QUERY}) AS term),
hit AS (
  SELECT p.doc, sum(idf.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.length / (SELECT avg(length) FROM lens)))) AS s
  FROM query AS q JOIN posts AS p USING (term) JOIN idf USING (term) JOIN lens AS l ON l.doc = p.doc GROUP BY 1),
bm AS (SELECT lens.doc, coalesce(s, 0) AS score FROM lens LEFT JOIN hit ON hit.doc = lens.doc)"""
_COS = """
unit AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sized AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) + 1e-9 AS n FROM unit),
cos AS (SELECT a.vec_id, q.vec_id AS qid, list_dot_product(a.v, q.v) / (a.n * q.n) AS cos FROM sized AS a, sized AS q WHERE q.vec_id < 10)"""
_LISTS = """
lex AS (SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS rank FROM bm QUALIFY rank <= 100),
den AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY round(max(cos), 9) DESC, vec_id) AS rank FROM cos WHERE qid < 5 GROUP BY 1 QUALIFY rank <= 100)"""
_LONG = _LISTS.replace("rank <= 100", f"rank <= {RETRIEVED}")

QUERIES = {
    "token_counts": (token_counts, "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1"),
    "bm25_scores": (bm25_scores, _TERMS + " SELECT doc, round(score, 6) AS score FROM bm"),
    "bm25_indexed": (bm25_indexed, _TERMS + " SELECT doc, round(score, 6) AS score FROM bm"),
    "bm25_top": (bm25_top, _TERMS + "," + _COS + "," + _LISTS + " SELECT doc, CAST(rank AS INT) AS rank FROM lex"),
    "bm25_rank_share": (bm25_rank_share, _TERMS + " SELECT doc, round(cume_dist() OVER (ORDER BY round(score, 9)), 9) AS share FROM bm"),
    "dense_scores": (
        dense_scores,
        "WITH " + _COS + """, a AS (
  SELECT vec_id, max(cos) FILTER (qid < 5) AS best, avg(cos) FILTER (qid < 5) AS mean, max(cos) FILTER (qid >= 5) AS worst, max(cos) FILTER (qid = 0) AS first,
    avg(cos) FILTER (qid >= 4) AS cover_mean, min(cos) FILTER (qid >= 4) AS cover_min, stddev_pop(cos) FILTER (qid >= 4) AS cover_std FROM cos GROUP BY 1)
SELECT vec_id, round(best, 6) AS best, round(mean, 6) AS mean, round(worst, 6) AS worst, round(first, 6) AS first, round(best - 0.4 * worst, 6) AS contrast, round(cover_mean, 6) AS cover_mean, round(cover_min, 6) AS cover_min, round(cover_std, 6) AS cover_std FROM a""",
    ),
    "mean_pooled": (mean_pooled, "SELECT label, CAST(place - 1 AS INT) AS place, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY 1, 2"),
    "likeness_to_first": (likeness_to_first, "SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-8), 6) AS cos FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) AS a, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0) AS b"),
    "dense_top": (dense_top, "WITH " + _COS + " SELECT vec_id, CAST(row_number() OVER (ORDER BY round(max(cos), 9) DESC, vec_id) AS INT) AS rank FROM cos WHERE qid < 5 GROUP BY 1 QUALIFY rank <= 100"),
    "hybrid_top": (
        hybrid_top,
        _TERMS + "," + _COS + "," + _LISTS + """, f AS (
  SELECT doc, round(sum(1 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY 1)
SELECT doc, rrf, CAST(row_number() OVER (ORDER BY rrf DESC, doc) AS INT) AS rank FROM f QUALIFY rank <= 50""",
    ),
    "bm25_retrieved": (bm25_retrieved, _TERMS + "," + _COS + "," + _LONG + " SELECT doc, CAST(rank AS INT) AS rank FROM lex"),
    "dense_retrieved": (dense_retrieved, _TERMS + "," + _COS + "," + _LONG + " SELECT doc AS vec_id, CAST(rank AS INT) AS rank FROM den"),
    "dense_neighbours": (
        dense_neighbours,
        "WITH " + _COS.replace("q.vec_id < 10", "q.vec_id % 100 = 0") + """, s AS (SELECT qid, vec_id, round(cos, 9) AS score FROM cos)
SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 100""",
    ),
    "hybrid_candidates": (
        hybrid_candidates,
        _TERMS + "," + _COS + "," + _LONG + f""", f AS (
  SELECT doc, round(sum(1 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY 1)
SELECT doc, rrf, CAST(row_number() OVER (ORDER BY rrf DESC, doc) AS INT) AS rank FROM f QUALIFY rank <= {CANDIDATES}""",
    ),
    "line_units": (
        line_units,
        """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
kept AS (SELECT doc_id, k, line FROM l WHERE trim(line, ' ') <> ''),
every AS (SELECT * FROM kept UNION ALL SELECT doc_id, 0, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS pos, md5(line) AS line_md5 FROM every""",
    ),
    "documents_by_language": (documents_by_language, "SELECT lang, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, count(DISTINCT account_code) AS n_accounts FROM documents GROUP BY 1"),
}
