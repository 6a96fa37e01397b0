"""Nested records to related flat tables by columnar shredding.

``shred`` turns every leaf path of a nested schema into a column of its own: for each record a sequence of
(repetition level, definition level, value), as columnar file formats store it.

* repetition level ``r``: at which repeated ancestor the entry continues a list (0: the record begins),
* definition level ``d``: how many of the optional or repeated ancestors are there; a value is there only
  at the leaf's greatest level.

``assemble`` rebuilds the table of one repeated ancestor from the level sequences of the leaves under it
alone; place numbers come from the repetition levels, absent lists and null entries from the definition
levels. Both are expressions over one row: no shuffle, no Python, and a scan reads only the leaves asked for.

Defined cases: a null list and an empty list give no row; a null entry gives a row without values, which
still takes its place number; a struct of nulls gives a row whose leaves are all null; map entries are a
list of (key, value). Repeated records stay repeated. An empty table gives empty tables. Columns that are
not asked for do not matter, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Leaf:
    """One leaf path; ``lists`` holds (path of the list, definition level of an entry's place in it)."""

    path: str
    dtype: T.DataType
    max_def: int
    lists: tuple[tuple[str, int], ...] = field(default=())

    @property
    def repeated_under(self) -> str:
        return self.lists[-1][0] if self.lists else ""


def _is_list(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType))


def leaves(kind: T.DataType, path: str, depth: int = 0, lists: tuple = ()) -> list[Leaf]:
    """All leaf paths under ``path`` in schema order; ``depth`` is the definition level of its parent."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaves(f.dataType, f"{path}.{f.name}", depth + 1, lists)]
    if isinstance(kind, T.MapType):
        kind = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
    if isinstance(kind, T.ArrayType):
        return leaves(kind.elementType, path, depth + 2, (*lists, (path, depth + 2)))
    return [Leaf(path, kind, depth + 1, lists)]


def _levels(col: Column, kind: T.DataType, steps: list[str], r: Column, d: int, depth: int, leaf: T.DataType) -> Column:
    def entry(level: Column | int, value: Column | None = None) -> Column:
        level = F.lit(level) if isinstance(level, int) else level
        value = F.lit(None).cast(leaf) if value is None else value
        return F.struct(r.cast("int").alias("r"), level.cast("int").alias("d"), value.alias("v"))

    if isinstance(kind, T.StructType):
        inner = _levels(col[steps[0]], kind[steps[0]].dataType, steps[1:], r, d + 1, depth, leaf)
        return F.when(col.isNull(), F.array(entry(d))).otherwise(inner)
    if _is_list(kind):
        if isinstance(kind, T.MapType):
            col = F.map_entries(col)
            element: T.DataType = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        else:
            element = kind.elementType
        if not _is_list(element) and not isinstance(element, T.StructType):
            each = F.transform(col, lambda x, i: F.struct(F.when(i == 0, r).otherwise(depth + 1).cast("int").alias("r"), F.when(x.isNull(), d + 2).otherwise(d + 3).cast("int").alias("d"), x.alias("v")))
        else:
            each = F.flatten(F.transform(col, lambda x, i: _levels(x, element, steps, F.when(i == 0, r).otherwise(depth + 1), d + 2, depth + 1, leaf)))
        return F.when(col.isNull(), F.array(entry(d))).when(F.size(col) == 0, F.array(entry(d + 1))).otherwise(each)
    return F.array(entry(F.when(col.isNull(), d).otherwise(d + 1), col))


def level_column(df: DataFrame, leaf: Leaf) -> Column:
    """array<struct<r, d, v>> of one leaf path."""
    root, *steps = leaf.path.split(".")
    return _levels(F.col(root), df.schema[root].dataType, steps, F.lit(0), 0, 0, leaf.dtype)


def shred(df: DataFrame, roots: list[str], keys: list[str]) -> tuple[DataFrame, list[Leaf]]:
    """``keys`` and one column of level sequences for every leaf path under ``roots``, named by the path."""
    found = [x for root in roots for x in leaves(df.schema[root].dataType, root)]
    return df.select(*keys, *(level_column(df, x).alias(x.path) for x in found)), found


def places(found: list[Leaf], ancestor: str) -> Column:
    """array<struct<at, leaf values...>> of the entries of ``ancestor`` with their leaves.

    ``at`` is the place in the list from 0, counted by the repetition levels; ``there`` is true where any
    leaf below has a value. Leaves under a list deeper than the ancestor belong to that list's own table.
    """
    own = [x for x in found if x.repeated_under == ancestor]
    level = own[0].lists[-1][1] if ancestor else 0
    depth = len(own[0].lists)
    zipped = F.arrays_zip(*(F.col(f"`{x.path}`").alias(f"l{k}") for k, x in enumerate(own)))

    def row(e: Column, at: Column) -> Column:
        there = reduce(lambda a, b: a | b, (e[f"l{k}"]["d"] == x.max_def for k, x in enumerate(own)))
        return F.struct(at.cast("int").alias("at"), (e["l0"]["d"] >= level).alias("placed"), there.alias("there"), *(e[f"l{k}"]["v"].alias(x.path.rpartition(".")[2]) for k, x in enumerate(own)))

    if depth <= 1:
        # One list: each entry after the first has r = 1, so the count of those is the position itself.
        return F.filter(F.transform(zipped, row), lambda e: e["placed"])
    # Deeper lists: the place restarts wherever the repetition level falls below the list's own.
    ats = F.aggregate(
        F.col(f"`{own[0].path}`"),
        F.array().cast("array<int>"),
        lambda acc, e: F.concat(acc, F.array(F.when(e["r"] < depth, 0).otherwise(F.coalesce(F.element_at(acc, -1), F.lit(-1)) + 1))),
    )
    counted = F.transform(F.arrays_zip(zipped.alias("e"), ats.alias("n")), lambda x: row(x["e"], x["n"]))
    return F.filter(counted, lambda e: e["placed"])


def assemble(levels: DataFrame, found: list[Leaf], ancestor: str, keys: list[str]) -> DataFrame:
    """The flat table of one repeated ancestor: ``keys``, ``item_no`` and its leaves."""
    own = [x for x in found if x.repeated_under == ancestor]
    inner = levels.select(*keys, F.explode(places(found, ancestor)).alias("_e"))
    return inner.select(*keys, F.col("_e.at").alias("item_no"), *(F.col(f"_e.{x.path.rpartition('.')[2]}") for x in own))
