"""Groups of linked nodes, and the pairs within groups, without a group in one task.

``groups_of`` merges links by alternating stars. A large star hangs every greater neighbour of a node on the
least node of its neighbourhood; a small star does the same with its lesser neighbours. Both are an aggregate of
the least and a join, so a group of any size is a stream of rows, never a structure in one task; a hub is a
skewed key of a join with one row a key, which the adaptive planner splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.tables import checkpoint

#: Items of a group that meet in one task of ``pairs_within`` and ``members_of``.
BLOCK = 4096


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a partition: (node, least node linked to it) but for the least itself."""
    parent: dict = {}

    def find(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kind = pa.int64()
    for b in batches:
        kind = b.column(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a"), F.least("a", "_m").alias("_m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("_m"))
    moved = links.join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return least.select("a", F.col("_m").alias("b")).unionByName(moved).distinct()


def groups_of(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the least node of its group.

    Links of a partition are merged before the first round. Links always run from the greater to the lesser
    node; rounds end when all are stars: no node under two others, none both under one and above one. Links
    of a node with itself make it a group of its own; null ends are left out; no links give no rows.
    """
    kind = dict(links.dtypes)["a"]
    whole = links.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).where("a is not null and b is not null")
    alone = whole.where("a = b").select(F.col("a").alias("node"))
    stars = checkpoint(whole.where("a <> b").mapInArrow(_local_stars, f"a {kind}, b {kind}").distinct())
    while True:
        ends = stars.select(F.col("a").alias("n"), F.col("b").alias("above"), F.lit(False).alias("is_root"))
        ends = ends.unionByName(stars.select(F.col("b").alias("n"), F.lit(None).cast(kind).alias("above"), F.lit(True).alias("is_root")))
        torn = ends.groupBy("n").agg(F.max("is_root").alias("_r"), F.min("above").alias("_x"), F.max("above").alias("_y")).where("_x <> _y or (_r and _x is not null)")
        if torn.isEmpty():
            break
        stars = checkpoint(_small_star(_large_star(stars)))
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    single = alone.distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(single)


def _parts(members: DataFrame, group: list[str]) -> DataFrame:
    """``group`` and ``_parts``: into how many parts each group is cut; sizes are summed before the shuffle."""
    return members.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts"))


def _part_of(item: str):
    return F.pmod(F.xxhash64(item), F.col("_parts")).cast("int")


def pairs_within(members: DataFrame, group: list[str], item: str) -> DataFrame:
    """(``group``, ``a``, ``b``): every pair of different items of a group, a < b; items are distinct in a group.

    A group is cut into parts; each of its items meets the parts one by one, so a task holds a part at most.
    """
    cut = members.select(*group, item).join(_parts(members, group), group)
    left = cut.select(*group, F.col(item).alias("a"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    right = cut.select(*group, F.col(item).alias("b"), _part_of(item).alias("_part"))
    return left.join(right, [*group, "_part"]).where("a < b").select(*group, "a", "b")


def members_of(rows: DataFrame, key: str, members: DataFrame, group: str, item: str, out: str) -> DataFrame:
    """``rows`` with every ``item`` of the group their ``key`` names, as ``out``; large groups are met part by part."""
    sizes = _parts(members, [group])
    right = members.select(group, item).join(sizes, group).select(F.col(group).alias(key), F.col(item).alias(out), _part_of(item).alias("_part"))
    left = rows.join(sizes.select(F.col(group).alias(key), "_parts"), key)
    left = left.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, [key, "_part"]).select(*rows.columns, out)
