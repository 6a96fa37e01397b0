"""p10: reading level of a text, by vocabulary coverage and sentence complexity, calibrated on graded texts.

The corpus gives every word a frequency rank. A text's coverage rank is the size of the smallest vocabulary,
taken from the top of that list, that covers ``COVERED`` of its words. With words per sentence and letters
per word it makes three measures, whose mean in each band, and common mean deviation, come from the graded
texts. A text gets the band with the least sum of deviations; absolute values keep one odd measure (a text
without full stops) from deciding alone. Everything is declared in SQL.

The ``HEAD_WORDS`` most frequent words are broadcast, which bounds their number; words behind them are looked up
by a shuffle. So a word on every text is never a key of one, and the words that are have few rows each.

The rank is counted from the number of words of each count, a table of at most sqrt(2 * words) rows, so no
task orders the whole vocabulary. Words of one count share the last rank among them; unseen words come after
all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions.tables import checkpoint, table

COVERED = 0.9
MIN_CHARS = 300
#: About 20 MB.
HEAD_WORDS = 200_000
MEASURES = ["coverage", "sentence", "letters"]
MARKUP, WORD, STOP = r"<[^<>]*>", r"\p{L}+(?:'\p{L}+)?", r"[.!?;]+(\s|\p{Lu}|$)|\n+"


def _words(text: str | F.Column = "text") -> F.Column:
    plain = F.regexp_replace(text, MARKUP, " ")
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def word_ranks(texts: DataFrame) -> DataFrame:
    """(word, rank, last) of every word of a table with ``text``; ``last`` is one more than the greatest rank."""
    counts = texts.select(F.explode(_words()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy("_n").agg(F.count(F.lit(1)).alias("_words"))
    upper = W.orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = sizes.select("_n", F.sum("_words").over(upper).alias("rank"), (F.sum("_words").over(W.partitionBy()) + 1).alias("last"))
    return counts.join(ranks, "_n").select("word", "rank", "last")


def _ranked(each: DataFrame, ranks: DataFrame, n_words: int, last: int) -> DataFrame:
    """``each`` with the rank of its ``word``; unseen words rank last."""
    words = ranks.select("word", "rank")
    # A rank counts the words up to it, so at most HEAD_WORDS words have one within it.
    found = each.join(F.broadcast(words.where(F.col("rank") <= HEAD_WORDS)), "word", "left")
    if n_words > HEAD_WORDS:
        rare = found.where("rank is null").drop("rank").join(words.where(F.col("rank") > HEAD_WORDS), "word", "left")
        found = found.where("rank is not null").unionByName(rare)
    return found.withColumn("rank", F.coalesce("rank", F.lit(last)))


def measured(texts: DataFrame, ranks: DataFrame, key: str, n_words: int, last: int) -> DataFrame:
    """``key`` and the three measures of each text that has a word; texts without one are left out."""
    stops = F.size(F.regexp_extract_all(F.regexp_replace("text", MARKUP, " "), F.lit(STOP), F.lit(0)))
    # Stops are counted once a text, below the explode.
    split = texts.where("text is not null").select(key, F.greatest(F.lit(1), stops).alias("_stops"), _words().alias("_all"))
    each = split.select(key, (F.size("_all") / F.col("_stops")).alias("_ratio"), F.explode("_all").alias("word"))
    return _ranked(each, ranks, n_words, last).groupBy(key).agg(
        F.expr(f"ln(percentile_disc({COVERED}) WITHIN GROUP (ORDER BY rank))").alias("coverage"),
        F.expr("ln(max(_ratio))").alias("sentence"),
        F.expr("avg(length(word))").alias("letters"),
    )


def band_model(graded: DataFrame) -> F.Column:
    """array<struct<band, means>> of all bands and the common mean deviations, as one column of fixed values.

    A row a band comes to the driver; bands are the few grades of a scale.
    """
    graded = checkpoint(graded)
    means = graded.groupBy("band").agg(*(F.avg(m).alias(m) for m in MEASURES))
    away = graded.join(means.select("band", *(F.col(m).alias(f"m_{m}") for m in MEASURES)), "band").agg(*(F.greatest(F.avg(F.abs(F.col(m) - F.col(f"m_{m}"))), F.lit(0.01)).alias(m) for m in MEASURES)).head()
    rows = [F.struct(F.lit(r["band"]).cast("int").alias("band"), *(F.lit(r[m]).alias(m) for m in MEASURES)) for r in means.orderBy("band").collect()]
    model = F.array(*rows) if rows else F.array().cast("array<struct<band:int,coverage:double,sentence:double,letters:double>>")
    gap = lambda k: sum((F.abs(F.col(m) - k[m]) / F.lit(away[m]) for m in MEASURES), F.lit(0.0))
    return F.array_min(F.transform(model, lambda k: F.struct(F.round(gap(k), 9).alias("gap"), k["band"].alias("band"))))


def reading_levels(texts: DataFrame, corpus: DataFrame, graded: DataFrame, key: str) -> DataFrame:
    """(key, band) of each text; a null text or one without any word gets none. Ties go to the easier band.

    A row given twice gets one band, equal texts get equal ones. Without graded texts no text gets a band.

    ``graded`` has ``sample_id``, ``text`` and ``band``; bands are few and known, so their model is fixed values
    of the plan and each text finds its band in its own row.
    """
    ranks = checkpoint(word_ranks(corpus))
    size = ranks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("last"), F.lit(1)).alias("last")).head()
    samples = measured(graded, ranks, "sample_id", size["n"], size["last"]).join(graded.select("sample_id", "band"), "sample_id")
    band = band_model(samples)["band"]
    return measured(texts, ranks, key, size["n"], size["last"]).select(key, band.alias("band")).where("band is not null")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = docs.where((F.col("lang") == "en") & (F.length("text") >= MIN_CHARS)).select("doc_id", "text")
    graded = table(spark, sf_dir, "graded_samples").select("sample_id", "text", "band")
    return reading_levels(texts, docs.select("text"), graded, "doc_id")


P10_SQL = r"""
WITH spoken AS (
  SELECT doc_id AS id, text, 0 AS band FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT -1 - sample_id, text, band FROM graded_samples),
plain AS (SELECT id, band, regexp_replace(text, '<[^<>]*>', ' ', 'g') AS text FROM spoken),
words AS (
  SELECT id, band, unnest(regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')) AS word FROM plain),
counts AS (SELECT word, count(*) AS n FROM words WHERE band = 0 GROUP BY 1),
ranks AS (SELECT word, sum(1) OVER (ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM counts),
wanted AS (
  SELECT -1 - sample_id AS id FROM graded_samples
  UNION ALL SELECT doc_id FROM documents WHERE lang = 'en' AND length(text) >= 300),
stops AS (SELECT id, greatest(1, len(regexp_extract_all(text, '[.!?;]+(\s|\p{Lu}|$)|\n+'))) AS stops FROM plain),
tokens AS (
  SELECT w.id, w.band, w.word, coalesce(r.rank, (SELECT max(rank) + 1 FROM ranks)) AS rank
  FROM words AS w JOIN wanted USING (id) LEFT JOIN ranks AS r USING (word)),
runs AS (
  SELECT id, rank, sum(count(*)) OVER (PARTITION BY id ORDER BY rank) AS upto, sum(count(*)) OVER (PARTITION BY id) AS total FROM tokens GROUP BY 1, 2),
cover AS (SELECT id, ln(min(rank)) AS coverage FROM runs WHERE upto >= 0.9 * total GROUP BY 1),
shape AS (SELECT id, any_value(band) AS band, count(*) AS n, avg(length(word)) AS letters FROM tokens GROUP BY 1),
m AS (SELECT id, band, coverage, ln(n / stops) AS sentence, letters FROM shape JOIN cover USING (id) JOIN stops USING (id)),
means AS (SELECT band, avg(coverage) AS mc, avg(sentence) AS ms, avg(letters) AS ml FROM m WHERE band > 0 GROUP BY 1),
dev AS (
  SELECT greatest(avg(abs(coverage - mc)), 0.01) AS dc, greatest(avg(abs(sentence - ms)), 0.01) AS ds, greatest(avg(abs(letters - ml)), 0.01) AS dl FROM m JOIN means USING (band)),
gaps AS (
  SELECT m.id, k.band, round(abs(coverage - mc) / dc + abs(sentence - ms) / ds + abs(letters - ml) / dl, 9) AS gap FROM m, means AS k, dev WHERE m.band = 0)
SELECT id AS doc_id, band FROM gaps QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, band) = 1
"""
