"""Lexical scores of documents, over the texts themselves or over an index held in tables.

An idf below zero becomes a quarter of the mean raw idf of the whole vocabulary, as in the common Okapi variant.
Query words count as often as they are given; documents without any score 0 and keep their rank.

Scores for a stated query need no postings: one pass counts in how many documents each word is, the query's
weights become fixed values of the plan, and each document is scored in its own row. An index is for many
queries: postings stored in buckets by term, so that a query reads the buckets of its words alone.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.config import EPSILON, K1, B
from quillrank.functions.tables import checkpoint
from quillrank.operators.text import tokenize

BUCKETS = 64


def query_words(query: str | list[str]) -> list[str]:
    """The words of a query given as text, or as a list of them."""
    return re.findall(r"[a-z0-9]+", query.lower()) if isinstance(query, str) else list(query)


@dataclass(frozen=True)
class Corpus:
    """Number of documents, mean length, mean raw idf, and (term, df) of the whole vocabulary."""

    n: int
    mean_length: float
    mean_idf: float
    terms: DataFrame

    def weights(self, query: str | list[str]) -> dict[str, float]:
        """The idf of each of the query's words, times the times it is given; at most a row a word reaches the driver."""
        times = Counter(query_words(query))
        known = self.terms.where(F.col("term").isin(*times)).select("term", _raw_idf(self.n).alias("r")).collect() if times else []
        return {r["term"]: times[r["term"]] * (EPSILON * self.mean_idf if r["r"] < 0 else r["r"]) for r in known}


def _raw_idf(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def corpus(docs: DataFrame, text: str) -> Corpus:
    """One pass over the texts: words are counted once a document, before the shuffle; an empty word stands for the document.

    Null texts have length 0 and no terms.
    """
    words = F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>"))
    each = docs.select(words.alias("_w")).select(F.size("_w").alias("_length"), F.explode(F.array_append(F.array_distinct("_w"), F.lit(""))).alias("term"))
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("_length"))).alias("_length"))
    counts = checkpoint(counts)
    whole = counts.where("term = ''").head()
    n = whole["df"] if whole else 0
    terms = counts.where("term <> ''").select("term", "df")
    mean = terms.agg(F.avg(_raw_idf(n)).alias("m")).head()["m"]
    return Corpus(n, (whole["_length"] or 0) / n if n else 0.0, mean or 0.0, terms)


def _part(weight: float | Column, tf: Column, length: Column, mean_length: float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean_length or 1.0)))


def score(text: str, stats: Corpus, query: str | list[str]) -> Column:
    """The score of a row's text for a query, with the corpus's weights as fixed values."""
    words = F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>"))
    length = F.size(words)
    times = lambda term: F.size(F.filter(words, lambda x: x == term)).cast("double")
    return sum((_part(w, times(term), length, stats.mean_length) for term, w in sorted(stats.weights(query).items())), F.lit(0.0))


def scores(docs: DataFrame, key: str, text: str, query: str | list[str]) -> DataFrame:
    """(doc, score) of every document for the query's words. Keys have to be unique."""
    stats = corpus(docs, text)
    return docs.select(F.col(key).alias("doc"), score(text, stats, query).alias("score"))


def write_index(docs: DataFrame, key: str, text: str, path: str, version: str = "") -> None:
    """An index as tables under ``path``: postings by term bucket, lengths, terms, and one row of totals.

    ``version`` names the state of the documents, for ``attach_index``. The totals are written last, so an
    index that was not finished cannot be attached.
    """
    words = docs.select(F.col(key).alias("doc"), F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>")).alias("_w"))
    each = words.select("doc", F.size("_w").alias("length"), F.explode("_w").alias("term"))
    posts = each.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    posts = posts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    # A word of every document is spread over tasks by document; each bucket is sorted, so row groups hold few terms.
    posts.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    words.select("doc", F.size("_w").alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")
    stats = corpus(docs, text)
    stats.terms.write.mode("overwrite").parquet(f"{path}/terms")
    totals = json.dumps({"n": stats.n, "mean_length": stats.mean_length, "mean_idf": stats.mean_idf, "version": version, "buckets": BUCKETS})
    docs.sparkSession.createDataFrame([(totals,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/totals")


@dataclass(frozen=True)
class Index:
    """A kept index; ``scores`` reads the postings of the query's words alone."""

    path: str
    stats: Corpus
    spark: SparkSession

    def scores(self, query: str | list[str]) -> DataFrame:
        weights = self.stats.weights(query)
        every = self.spark.read.parquet(f"{self.path}/lengths").select("doc")
        if not weights:
            return every.select("doc", F.lit(0.0).alias("score"))
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in weights], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(*buckets) & F.col("term").isin(*weights))
        weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("term")]
        found = hits.groupBy("doc").agg(F.sum(_part(weight, F.col("tf").cast("double"), F.col("length"), self.stats.mean_length)).alias("score"))
        return every.join(found, "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def attach_index(spark: SparkSession, path: str, version: str = "") -> Index | None:
    """The index under ``path``, or None where there is none, it was not finished, or it is of another version."""
    try:
        row = spark.read.text(f"{path}/totals").head()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    kept = json.loads(row[0]) if row else {}
    if kept.get("version") != version or kept.get("buckets") != BUCKETS:
        return None
    return Index(path, Corpus(kept["n"], kept["mean_length"], kept["mean_idf"], spark.read.parquet(f"{path}/terms")), spark)


def index_of(docs: DataFrame, key: str, text: str, path: str, version: str = "") -> Index:
    """The kept index if it is of this version, else a new one."""
    found = attach_index(docs.sparkSession, path, version)
    if found is None:
        write_index(docs, key, text, path, version)
        found = attach_index(docs.sparkSession, path, version)
    return found
