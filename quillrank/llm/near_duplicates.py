"""p5: near-duplicate records by SuperMinHash, banding, verification and union-find.

A text's shingles are sets of hashed word runs. SuperMinHash gives every shingle one random order of the m
signature slots: its value in the slot it puts at place j lies between j and j + 1, and a slot keeps the
least value. The places of one shingle are tied to each other, which lowers the variance against independent
hashes, and once every slot holds a value below j no place from j on can matter, so the rounds stop early
(after about m * ln(m) / n of m). The rounds run over all shingles of a batch of texts at once.

Texts that agree in all slots of a band are candidates; candidates whose sketches (two bits a slot) agree in too
few slots to come from a pair at the threshold (five standard deviations below) are dropped, the rest are
verified on the shingle sets themselves, so no wrong pair comes out. Equal texts, told by 128 bits of hash, are
one class from the start: a group of copies takes part once, however large. Classes are grouped by ``groups_of``.

What is kept between steps are the distinct texts, compressed; shingles are cut again where they are wanted.
Joins on bands and pairs are merge joins: the planner guesses at the size of a table with many rows a text by
that of its file and would broadcast it. A band in very many texts, found in a sample of them, is met part by
part; the sample decides where the work goes, never what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tables import kept, table
from quillrank.llm.grouping import groups_of, members_of, pairs_within

BANDS, ROWS = 64, 4
SLOTS = BANDS * ROWS
WORDS, MIN_WORDS, SIMILARITY = 3, 40, 0.5
BATCH_SHINGLES = 60_000
#: Bits of a slot in a sketch.
SKETCH_BITS = 2
#: One text of so many is looked at for bands in very many texts; a band is cut into parts of about so many texts.
SAMPLED, PART = 64, 8192
#: Bands that are cut at most, as their list is broadcast; any further ones are left to the planner's skew handling.
MAX_HOT = 100_000
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; sums and products wrap."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def super_minhash(hashes: np.ndarray, doc: np.ndarray, n_docs: int, m: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs, m) of documents given as parallel arrays of shingle hash and document number.

    Documents without shingles keep the value m in every slot.
    """
    h = np.full((n_docs, m), float(m))
    seed = hashes.astype(np.uint64)
    order = np.tile(np.arange(m, dtype=np.int16), (len(seed), 1))
    alive = np.arange(len(seed))
    for j in range(m):
        if not len(alive):
            break
        with np.errstate(over="ignore"):
            bits = _mix(seed[alive] + np.uint64(j + 1) * _GOLDEN)
        share = (bits >> np.uint64(40)).astype(np.float64) / float(1 << 24)
        pick = j + ((bits & np.uint64(0xFFFFFF)).astype(np.int64) * (m - j) >> 24)
        slot = order[alive, pick]
        order[alive, pick] = order[alive, j]
        order[alive, j] = slot
        np.minimum.at(h, (doc[alive], slot), share + j)
        # A document goes on only while some slot could still take a value of the next round.
        wanting = h.max(axis=1) > j + 1
        alive = alive[wanting[doc[alive]]]
    return h


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_shingles(w: Column, words: int) -> Column:
    """Distinct hashes of the runs of ``words`` words of a column of word lists; none for shorter ones.

    ``w`` has to be a plain column: an expression would be computed again for every place.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
    runs = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
    return F.when(F.size(w) >= words, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def signatures(shingled: DataFrame, key: str, shingles: str, m: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """``key``, ``bands`` (a hash of each band) and ``sketch`` (SKETCH_BITS bits of each slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, lists = b.column(0), b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ends = np.cumsum(lengths)
            at = 0
            while at < len(lengths):
                base = ends[at - 1] if at else 0
                until = max(at + 1, int(np.searchsorted(ends, base + BATCH_SHINGLES, side="right")))
                n = until - at
                doc = np.repeat(np.arange(n), lengths[at:until])
                h = super_minhash(flat[base : ends[until - 1]], doc, n, m)
                with np.errstate(over="ignore"):
                    v = _mix(h.view(np.uint64))
                    bands = v[:, 0::rows].copy()
                    for k in range(1, rows):
                        bands = _mix(bands * _GOLDEN + v[:, k::rows])
                    bands = bands + np.arange(m // rows, dtype=np.uint64)[None, :]
                sketch = np.packbits(np.concatenate([(v >> np.uint64(k)) & np.uint64(1) for k in range(SKETCH_BITS)], axis=1).astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(at, n),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (m // rows), bands.view(np.int64).ravel()),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    [key, "bands", "sketch"],
                )
                at = until

    kind = dict(shingled.dtypes)[key]
    return shingled.select(key, shingles).mapInArrow(run, f"`{key}` {kind}, bands array<bigint>, sketch binary")


def _alike(pairs: DataFrame, least: int, m: int) -> DataFrame:
    """Pairs whose sketches agree in at least ``least`` of ``m`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                unlike = np.unpackbits(x ^ y, axis=1)[:, : SKETCH_BITS * m].reshape(b.num_rows, SKETCH_BITS, m).any(axis=1)
                b = b.filter(pa.array(m - unlike.sum(axis=1) >= least))
            yield b.select(["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def banded_pairs(signed: DataFrame) -> DataFrame:
    """(a, b), a < b, of the classes that share a band."""
    one_of = F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(SAMPLED)) == 0
    hot = signed.where(one_of).select(F.explode("bands").alias("band")).groupBy("band").agg(F.ceil(F.count(F.lit(1)) * SAMPLED / PART).cast("int").alias("_parts")).where("_parts > 1")
    hot = kept(hot.orderBy(F.desc("_parts")).limit(MAX_HOT))
    keyed = signed.select("class_id", F.explode("bands").alias("band"))
    if hot.isEmpty():
        left, right, keys = keyed.select(F.col("class_id").alias("a"), "band"), keyed.select(F.col("class_id").alias("b"), "band"), ["band"]
    else:
        keyed, keys = keyed.join(F.broadcast(hot), "band", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))), ["band", "_part"]
        left = keyed.select(F.col("class_id").alias("a"), "band", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
        right = keyed.select(F.col("class_id").alias("b"), "band", F.pmod(F.xxhash64("class_id"), F.col("_parts")).cast("int").alias("_part"))
    return left.join(right.hint("merge"), keys).where("a < b").select("a", "b").distinct()


def shingled(texts: DataFrame, words: int = WORDS, least: int = MIN_WORDS) -> DataFrame:
    """(class_id, shingles) of the texts of at least ``least`` words."""
    split = texts.select("class_id", words_of(F.col("text")).alias("_w")).where(F.size("_w") >= least)
    return split.select("class_id", word_shingles(F.col("_w"), words).alias("shingles"))


def similar_pairs(texts: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, least_words: int = MIN_WORDS) -> DataFrame:
    """(a, b, similarity) of texts with a Jaccard similarity of at least ``similarity``; a < b.

    ``texts`` has ``class_id`` (bigint, unique) and ``text``, ``signed`` the ``signatures`` of their shingles. The
    chance to miss a pair of similarity s is (1 - s**rows)**bands: 1.6 % at 0.5, 0.002 % at 0.62.
    """
    m = bands * rows
    sketch = signed.select("class_id", "sketch")
    pairs = banded_pairs(signed)
    with_sketch = pairs.join(sketch.select(F.col("class_id").alias("a"), F.col("sketch").alias("sketch_a")).hint("merge"), "a").join(sketch.select(F.col("class_id").alias("b"), F.col("sketch").alias("sketch_b")).hint("merge"), "b")
    # Slots of unlike values still agree in these bits once in 2 ** SKETCH_BITS.
    agree = similarity + (1 - similarity) / 2**SKETCH_BITS
    least = int(max(1, np.floor(m * agree - 5 * np.sqrt(m * agree * (1 - agree)))))
    near = kept(_alike(with_sketch, least, m))
    # Shingles are cut again, of the texts that are in a pair alone.
    ids = near.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    sets = shingled(texts.join(ids, "class_id", "left_semi"), words, least_words)
    both = near.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("_x")).hint("merge"), "a").join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("_y")).hint("merge"), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.select("a", "b", (common / (F.size("_x") + F.size("_y") - common)).alias("similarity")).where(F.col("similarity") >= similarity)


def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, record_id, text_key, text) of each record; ``text_key`` is 128 bits of hash of the text.

    A null headline, summary, entry or description adds nothing; candidates without an id are left out.
    """
    c = table(spark, sf_dir, "candidates").where("candidate_id is not null")
    text = F.lower(F.concat_ws(" ", "profile.headline", "profile.summary", "career_history.description"))
    rows = c.select("candidate_id", "record_id", text.alias("text"))
    return rows.select("candidate_id", "record_id", F.unhex(F.md5("text")).alias("text_key"), "text")


def text_classes(texts: DataFrame) -> DataFrame:
    """(class_id, text_key, text) of the distinct texts; the id is the least record's."""
    return texts.groupBy("text_key").agg(F.min("record_id").alias("class_id"), F.first("text").alias("text")).select("class_id", "text_key", "text")


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidate_id, class_id) of the texts of at least MIN_WORDS words, and the similar pairs of classes."""
    texts = candidate_texts(spark, sf_dir)
    classes = kept(text_classes(texts))
    signed = kept(signatures(shingled(classes), "class_id", "shingles"))
    long = classes.select("class_id", "text_key").join(signed.select("class_id"), "class_id", "left_semi")
    members = texts.select("candidate_id", "text_key").distinct().join(long, "text_key").select("candidate_id", "class_id")
    return kept(members), similar_pairs(classes.select("class_id", "text"), signed)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different candidates with similar texts, the smaller id first.

    Texts of fewer than MIN_WORDS words (null and empty ones too) are in no pair; a candidate delivered twice
    is one candidate; texts are taken whole, however long; an empty table gives no pairs.
    """
    members, pairs = _linked(spark, sf_dir)
    across = members_of(pairs.select("a", "b"), "a", members, "class_id", "candidate_id", "_x")
    across = members_of(across, "b", members, "class_id", "candidate_id", "_y").select("_x", "_y")
    within = pairs_within(members, ["class_id"], "candidate_id").select(F.col("a").alias("_x"), F.col("b").alias("_y"))
    both = across.unionByName(within).where("_x <> _y")
    return both.select(F.least("_x", "_y").alias("candidate_a"), F.greatest("_x", "_y").alias("candidate_b")).distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate and text: its class (equal texts) and its group of similar classes."""
    members, pairs = _linked(spark, sf_dir)
    groups = groups_of(pairs)
    return members.join(groups, members["class_id"] == groups["node"], "left").select("candidate_id", "class_id", F.coalesce("root", "class_id").alias("group_id"))


P5_FOUND_SQL = r"""
WITH texts AS (
  SELECT DISTINCT candidate_id, lower(concat_ws(' ', profile.headline, profile.summary, array_to_string(list_filter(list_transform(career_history, lambda j: j.description), lambda d: d IS NOT NULL), ' '))) AS t
  FROM candidates WHERE candidate_id IS NOT NULL),
cut AS (SELECT t, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT t FROM texts)),
sets AS (SELECT t, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM cut WHERE len(w) >= 40),
each_ AS (SELECT t, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.t AS x, b.t AS y, a.n AS n, b.n AS k, count(*) AS c FROM each_ AS a JOIN each_ AS b ON a.g = b.g AND a.t <= b.t GROUP BY 1, 2, 3, 4),
near AS (SELECT x, y FROM common WHERE 2 * c >= n + k - c),
pairs AS (SELECT a.candidate_id AS i, b.candidate_id AS j FROM near JOIN texts AS a ON a.t = x JOIN texts AS b ON b.t = y WHERE a.candidate_id <> b.candidate_id)
SELECT DISTINCT least(i, j) AS candidate_a, greatest(i, j) AS candidate_b FROM pairs
"""
