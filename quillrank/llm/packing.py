"""p9: filling containers of fixed capacity, best fit with conflicts.

Items go in by size, largest first (those that conflict with most others before all), into the open container
with the least room left that still holds them and is in no conflict with them. Containers are kept ordered by
room left; each carries two bitmaps: of the texts with copies that are inside, and of the sources that have had
their part of it. The search starts at the tightest container that holds the item and goes on to its successors
until one is in no conflict; there is no bound on it, and where none is left a container is opened. An item that
not even an empty container holds is cut: full containers, and a rest that is an item again.

* A text goes into a container once (copies in more number than there are containers are spread evenly).
* A source has had its part of a container once its items there reach ``SOURCE_PART`` of the capacity, or one and
  a half times its part of all tokens where that is more (else a source with most of the tokens could not be
  placed without empty room). Unknown sources have no part.

Items are packed in blocks by a hash of their key, about ``BLOCK_ITEMS`` to a block, so the work spreads however
many there are; the containers that a block leaves open (filled below ``CLOSED``) are emptied and their items
packed in a second round with those of the other blocks. So above one block "tightest" is of the containers of a
block. Copies of one text are equally large and go in together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tables import checkpoint, table
from quillrank.llm.encoding import encode_table

BLOCK_ITEMS = 20_000
SOURCE_PART, CLOSED = 0.5, 0.98


def source_limits(sizes: list[int], sources: list[int], capacity: int) -> dict[int, int]:
    """Tokens of a container after which a source has had its part of it."""
    tokens: Counter = Counter()
    for n, s in zip(sizes, sources):
        tokens[s] += n
    every = max(1, sum(tokens.values()))
    return {s: max(1, int(capacity * min(1.0, max(SOURCE_PART, 1.5 * n / every)))) for s, n in tokens.items()}


def pack(sizes: list[int], clusters: list[int], sources: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, part, tokens, container) of every part; sizes are at least 1.

    Cluster -1 and source -1 (unknown) conflict with nothing.
    """
    parts: list[tuple[int, int, int, int]] = []
    opened = 0
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(sizes):
        part = 0
        while n > capacity:
            # Not even an empty container holds it.
            parts.append((i, part, capacity, opened))
            opened, part, n = opened + 1, part + 1, n - capacity
        rest.append((i, part, n))
    limits = source_limits([n for _, _, n in rest], sources, capacity)
    copies = Counter(c for c in clusters if c >= 0)
    # Texts with copies for many of the containers needed go in first, while there is room in all of them.
    many = max(2, -(-sum(n for _, _, n in rest) // capacity) // 16)
    rest.sort(key=lambda x: (-copies[clusters[x[0]]] if copies[clusters[x[0]]] > many else 0, -x[2], clusters[x[0]], x[0]))
    room: list[tuple[int, int]] = []
    held_clusters: dict[int, int] = {}
    had_sources: dict[int, int] = {}
    of_source: dict[tuple[int, int], int] = {}
    at = 0
    while at < len(rest):
        size, cluster = rest[at][2], clusters[rest[at][0]]
        until = at + 1
        while cluster >= 0 and until < len(rest) and rest[until][2] == size and clusters[rest[until][0]] == cluster:
            until += 1
        bit = 1 << cluster if cluster >= 0 and copies[cluster] > 1 else 0
        taken: list[tuple[int, int]] = []
        for i, part, _ in rest[at:until]:
            source = sources[i]
            own = 1 << source if source >= 0 else 0
            k = bisect_left(room, (size, -1))
            while k < len(room) and (held_clusters[room[k][1]] & bit or had_sources[room[k][1]] & own):
                k += 1
            if k < len(room):
                left, bin_no = room.pop(k)
            else:
                left, bin_no, opened = capacity, opened, opened + 1
                held_clusters[bin_no] = had_sources[bin_no] = 0
            parts.append((i, part, size, bin_no))
            held_clusters[bin_no] |= bit
            if own:
                of_source[bin_no, source] = of_source.get((bin_no, source), 0) + size
                if of_source[bin_no, source] >= limits[source]:
                    had_sources[bin_no] |= own
            taken.append((left - size, bin_no))
        for left, bin_no in taken:
            if left:
                insort(room, (left, bin_no))
        at = until
    return parts


def _apart(clusters: list[int], containers: int) -> list[int]:
    """Clusters with more copies than there must be containers are cut into as many as it takes.

    Copies of such a text cannot all be kept apart without containers that hold little else; so each
    container holds at most as many of them as their number over the containers needed.
    """
    number: dict[tuple[int, int], int] = {}
    seen: Counter = Counter()
    out = []
    for c in clusters:
        if c < 0:
            out.append(-1)
            continue
        out.append(number.setdefault((c, seen[c] // containers), len(number)))
        seen[c] += 1
    return out


def _block_packer(capacities: dict[int, int], key: str, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        window, block = int(pdf["window_id"].iloc[0]), int(pdf["_block"].iloc[0])
        capacity = capacities[window]
        pdf = pdf.sort_values(key, ignore_index=True, kind="stable")
        none = pdf[pdf["n_tokens"] == 0]
        pdf = pdf[pdf["n_tokens"] > 0].reset_index(drop=True)
        times = pdf["_cluster"].value_counts()
        number = {c: k for k, c in enumerate(times[times > 1].index)}
        clusters = [number.get(c, -1) for c in pdf["_cluster"]]
        sources, sizes = pd.factorize(pdf["_source"])[0].tolist(), pdf["n_tokens"].tolist()
        # Full containers of large items are no room for copies: what counts are the rests.
        rests = sum((n - 1) % capacity + 1 for n in sizes)
        found = pd.DataFrame(pack(sizes, _apart(clusters, max(1, -(-rests // capacity))), sources, capacity), columns=["_i", "_part", "_n", "_c"])
        used = found.groupby("_c")["_n"].transform("sum")
        out = pdf.iloc[found["_i"]].reset_index(drop=True)
        # A part of an item that is packed again keeps its number.
        out = out.assign(part_no=out["part_no"] + found["_part"], n_tokens=found["_n"], container_id=(block << 32) + found["_c"] + (0 if not last else 1 << 31), _open=(used < CLOSED * capacity) & (not last))
        out = pd.concat([out, none.assign(container_id=pd.NA, _open=False)], ignore_index=True)
        return out.astype({"container_id": "Int64"})[["window_id", "container_id", key, "part_no", "n_tokens", "_cluster", "_source", "_open"]]

    return run


def fill_containers(items: DataFrame, windows: list[tuple[int, int]], n_items: int, key: str = "doc_id") -> DataFrame:
    """(window_id, container_id, key, part_no, n_tokens) of every part of every item for each capacity.

    ``items`` has ``key``, ``n_tokens``, ``_cluster`` (equal for copies of a text) and ``_source``. An item
    larger than the capacity is cut into full containers and a rest that is packed like an item; no other is
    cut. Items of no tokens take no room: container_id is null. Null sources conflict with nothing; repeated
    keys are items of their own.
    """
    if any(c < 1 for _, c in windows):
        raise ValueError("a window holds at least one token")
    kinds = dict(items.dtypes)
    schema = f"window_id int, container_id bigint, `{key}` {kinds[key]}, part_no int, n_tokens int, _cluster bigint, _source string, _open boolean"
    each = F.explode(F.array(*(F.lit(w).cast("int") for w, _ in windows))) if windows else F.explode(F.array().cast("array<int>"))
    every = items.select(each.alias("window_id"), key, F.lit(0).alias("part_no"), F.col("n_tokens").cast("int").alias("n_tokens"), "_cluster", F.col("_source").cast("string").alias("_source"))
    capacities = dict(windows)

    def packed(rows: DataFrame, blocks, last: bool) -> DataFrame:
        return rows.withColumn("_block", F.pmod(F.xxhash64(key, F.lit(int(last))), blocks).cast("int")).groupBy("window_id", "_block").applyInPandas(_block_packer(capacities, key, last), schema)

    blocks = max(1, -(-n_items // BLOCK_ITEMS))
    out = ["window_id", "container_id", key, "part_no", "n_tokens"]
    if blocks == 1:
        return packed(every, F.lit(1), True).select(*out)
    first = checkpoint(packed(every, F.lit(blocks), False))
    # One row a window comes to the driver.
    left = {r["window_id"]: max(1, -(-r["n"] // BLOCK_ITEMS)) for r in first.where("_open").groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    again = F.coalesce(*(F.when(F.col("window_id") == w, F.lit(n)) for w, n in left.items()), F.lit(1))
    second = packed(first.where("_open").select("window_id", key, "part_no", "n_tokens", "_cluster", "_source"), again, True)
    return first.where("not _open").select(*out).unionByName(second.select(*out))


def document_containers(spark: SparkSession, sf_dir: str, window_name: str | None = None) -> DataFrame:
    """The containers of the documents for every window, or for one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    wanted = table(spark, sf_dir, "context_windows").where(F.lit(window_name is None) | (F.col("window_name") == window_name))
    windows = [(r["window_id"], r["capacity_tokens"]) for r in wanted.collect()]
    folded = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    sized = encode_table(docs.withColumn("_key", F.struct("doc_id", F.xxhash64(folded).alias("_cluster"), F.col("source").alias("_source"))), key="_key", counts=True)
    items = sized.select("_key.doc_id", "_key._cluster", "_key._source", "n_tokens")
    return fill_containers(items, windows, docs.count())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to cut for the window ``teacher_prompt``; empty tables give none."""
    return document_containers(spark, sf_dir, "teacher_prompt").where("part_no = 1").select("doc_id")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room used, for each window."""
    capacity = table(spark, sf_dir, "context_windows").select("window_id", "window_name", "capacity_tokens")
    used = document_containers(spark, sf_dir).where("container_id is not null").groupBy("window_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(F.broadcast(capacity), "window_id").select("window_name", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each window: documents placed or empty, and what must not be: containers too full, documents cut though
    they fit, parts not full though others follow, sources with a whole item above their part."""
    capacity = table(spark, sf_dir, "context_windows").select("window_id", "window_name", "capacity_tokens")
    parts = checkpoint(document_containers(spark, sf_dir)).join(F.broadcast(capacity), "window_id")
    docs = parts.groupBy("window_id", "window_name", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("part_no").alias("d"), F.max("part_no").alias("m"), F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("c"), F.sum((F.col("n_tokens") == F.col("capacity_tokens")).cast("int")).alias("full"))
    docs = docs.groupBy("window_id", "window_name").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(((F.col("k") > 1) & (F.col("n") <= F.col("c"))).cast("bigint")).alias("n_cut_though_fit"), F.sum(((F.col("k") != F.col("d")) | (F.col("m") + 1 != F.col("k")) | (F.col("full") < F.col("k") - 1)).cast("bigint")).alias("n_bad_parts"))
    bins = parts.where("container_id is not null").groupBy("window_id", "container_id").agg((F.sum("n_tokens") > F.max("capacity_tokens")).cast("bigint").alias("o")).groupBy("window_id").agg(F.sum("o").alias("n_overfull"))
    return docs.join(bins, "window_id").select("window_name", "n_documents", "n_cut_though_fit", "n_bad_parts", "n_overfull")


P9_CHECKS_SQL = """
SELECT window_name, (SELECT count(*) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS n_cut_though_fit, CAST(0 AS BIGINT) AS n_bad_parts, CAST(0 AS BIGINT) AS n_overfull FROM context_windows
"""
