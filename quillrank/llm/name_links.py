"""p3: spellings of the same organisation, by a trie join.

1. Distinct spellings are parsed (``spellings``): legal form, place and remarks go, kind words (in whatever
   short form) are named, what is left are the letters of the name proper. Spellings with equal letters and
   kind are one node; a node weighs as many rows as they have.
2. Nodes are joined within a bounded edit distance, those with a kind with their own kind, those without with
   all. A name is cut into one segment more than it may have edits, so two names within the bound share a whole
   segment at nearly the same place, and nodes are sharded by length, place and segment. Each shard's names
   become a trie, walked with the Levenshtein automaton of every query of the shard, in other orders of its
   words too (``orders``).
3. A node follows the nearest node that outweighs it (misspellings are rarer than the right form, two right
   forms are not), one without a kind the one of any kind, or where none is near one without. Stars of links
   give the organisations.
4. An abbreviation belongs to the heaviest organisation with these initials.

Sharding keeps what meets in one place to spellings that share a segment; rows are summed to distinct spellings
before they are parsed, so a name on a third of all rows is one spelling.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.functions.tables import checkpoint, table, task_count
from quillrank.llm.grouping import groups_of, pairs_within
from quillrank.llm.spellings import parse_name
from quillrank.llm.tries import Trie

ANY_KIND = "*"
#: Words of a name up to which every word is looked for at every place of the sorted name.
MOVED = 24
#: A node follows another only if that has at least this many times its rows, by edits between them.
OUTWEIGHS = {0: 0.0, 1: 1.0, 2: 1.2, 3: 4.0}


def most_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 7 else 2 if length < 12 else 3


@lru_cache(None)
def _segments(length: int) -> list[tuple[int, int]]:
    """(start, end) of the segments of a name of that length: one more than edits to any name within the bound."""
    n = min(length, 1 + max(most_edits(n) for n in range(length, length + 4) if n - length <= most_edits(n)))
    cuts = [length * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def index_keys(name: str) -> list[str]:
    return [f"{len(name)}|{k}|{name[a:b]}" for k, (a, b) in enumerate(_segments(len(name)))]


def query_keys(name: str) -> set[str]:
    """Keys of every shard that may hold a name within the bound of the longer length.

    Every edit belongs to one segment, a swap over a border to the left one. Of e + 1 segments and at most e
    edits there is a first one with no edit of its own and no more edits before it than segments, so no more
    behind it than segments: segment k starts at most k places off from the left and n - 1 - k places off from
    the right end. Its first letter may have changed places with the one before it; that is a second key.
    """
    out = set()
    for length in range(max(1, len(name) - 3), len(name) + 4):
        more = len(name) - length
        if abs(more) > most_edits(max(length, len(name))):
            continue
        cuts = _segments(length)
        for k, (a, b) in enumerate(cuts):
            right = len(cuts) - 1 - k
            for at in range(max(0, a - k, a + more - right), min(len(name) - (b - a), a + k, a + more + right) + 1):
                out.add(f"{length}|{k}|{name[at : at + b - a]}")
                if k and at:
                    out.add(f"{length}|{k}|{name[at - 1] + name[at + 1 : at + b - a]}")
    return out


def _sorted_run(words: list[str]) -> str:
    return "".join(sorted(words))


def orders(words: list[str]) -> list[str]:
    """The words run together in the orders they may be typed in.

    Up to four words: every order. More: each rotation, and the words sorted, as an index holds them too; as a
    misspelt word may sort elsewhere, with each word moved to each place. Of more than MOVED words only as
    written and sorted: that is no name but a text.
    """
    if len(words) <= 4:
        return sorted({"".join(p) for p in permutations(words)})
    by_letter = sorted(words)
    if len(words) > MOVED:
        return sorted({"".join(words), "".join(by_letter)})
    turns = {"".join(words[k:] + words[:k]) for k in range(len(words))}
    for k in range(len(words)):
        rest = by_letter[:k] + by_letter[k + 1 :]
        turns |= {"".join([*rest[:at], by_letter[k], *rest[at:]]) for at in range(len(words))}
    return sorted(turns)


def _parse(field: pd.Series, name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(n, f) for f, n in zip(field, name)], columns=["kind", "letters", "words", "initials"])


def parsed_names(names: DataFrame) -> DataFrame:
    """``names`` (field_name, name, n) with their parse and node; spellings that name nothing are left out.

    ``names`` has to be a table read or kept, not an aggregate: the filter on what the parse gives would be pushed
    below it, and the parse with it, onto every row.
    """
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("letters", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("initials", T.StringType())])
    # Few bytes, much work: the number of tasks is stated, as by size all would be one.
    p = names.repartition(task_count(names.sparkSession), "name").withColumn("_p", F.pandas_udf(_parse, kind)("field_name", "name"))
    joined = F.array_join("_p.words", "")
    node = F.concat_ws("|", "field_name", "_p.kind", "_p.letters", joined)
    return p.where((joined != "") | (F.col("_p.letters") != "")).select("field_name", "name", "n", "_p.*", joined.alias("run"), node.alias("node"))


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each shard that holds a node: under its kind and under any kind; under the empty kind if it has none."""
    for pdf in batches:
        rows = []
        for field, kind, run, words, node in zip(pdf["field_name"], pdf["kind"], pdf["run"], pdf["words"], pdf["node"]):
            for held in dict.fromkeys([run, _sorted_run(list(words))] if len(words) > 4 else [run]):
                rows += [(f"{field}|{k}|{key}", False, held, node) for key in index_keys(held) for k in ((kind, ANY_KIND) if kind else ("",))]
        yield pd.DataFrame(rows, columns=["shard", "is_query", "name", "node"])


def _queried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each shard a node has to look into, in each order of its words."""
    for pdf in batches:
        rows = []
        for field, kind, words, node in zip(pdf["field_name"], pdf["kind"], pdf["words"], pdf["node"]):
            for turn in orders(list(words)):
                rows += [(f"{field}|{k}|{key}", True, turn, node) for key in query_keys(turn) for k in ((kind,) if kind else (ANY_KIND, ""))]
        yield pd.DataFrame(rows, columns=["shard", "is_query", "name", "node"])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, names before queries: a trie a shard, walked by each query."""
    shard, trie, nodes = None, Trie(), {}
    for pdf in batches:
        out = []
        for key, is_query, name, node in zip(pdf["shard"], pdf["is_query"], pdf["name"], pdf["node"]):
            if key != shard:
                shard, trie, nodes = key, Trie(), {}
            if not is_query:
                trie.add(name)
                nodes.setdefault(name, []).append(node)
            elif nodes:
                edits = most_edits(max(len(name), int(key.split("|")[2])))
                out += [(node, other, d) for near, d in trie.near(name, edits) for other in nodes[near] if other != node]
        yield pd.DataFrame(out, columns=["node", "other", "edits"])


def near_nodes(nodes: DataFrame) -> DataFrame:
    """(node, other, edits): each node with the nodes of its kind within the bound, in any word order; of all kinds if it has none."""
    row = "shard string, is_query boolean, name string, node string"
    own = nodes.select("field_name", "kind", "words", "run", "node")
    held = own.mapInPandas(_indexed, row)
    # Most shards a node could look into hold no name.
    tasks = task_count(nodes.sparkSession)
    looked = own.repartition(tasks, "node").mapInPandas(_queried, row).join(held.select("shard").distinct(), "shard", "left_semi")
    met = held.unionByName(looked).repartition(tasks, "shard").sortWithinPartitions("shard", "is_query")
    return met.mapInPandas(_walk, "node string, other string, edits int").groupBy("node", "other").agg(F.min("edits").alias("edits"))


def linked_names(names: DataFrame) -> DataFrame:
    """(field_name, name, organisation) of all spellings that name an organisation.

    ``names`` has distinct (field_name, name) and ``n``, the rows of each. Null names have to be left out
    before. Spellings of nothing (blank, self-employed, confidential) get no row.
    """
    parsed = checkpoint(parsed_names(checkpoint(names)))
    full = parsed.where("letters = ''")
    nodes = checkpoint(full.groupBy("node", "field_name", "kind", "run").agg(F.sum("n").alias("n"), F.max(F.struct(F.size("words").alias("k"), "words"))["words"].alias("words")))
    weight = nodes.select("node", "n", (F.col("kind") == "").alias("bare"))
    near = near_nodes(nodes).join(weight.select("node", F.col("n").alias("own")), "node").join(weight.select(F.col("node").alias("other"), F.col("n").alias("theirs"), "bare"), "other")
    ratio = F.create_map(*(F.lit(x) for kv in OUTWEIGHS.items() for x in kv))[F.col("edits")]
    fit = near.where((F.col("theirs") >= ratio * F.col("own")) & ((F.col("edits") == 0) | (F.col("theirs") > F.col("own")) | ((F.col("theirs") == F.col("own")) & (F.col("other") < F.col("node")) & (F.col("edits") == 1) & (F.col("own") <= 2))))
    best = fit.groupBy("node").agg(F.min(F.struct("bare", "edits", (-F.col("theirs")).alias("_w"), "other")).alias("_b")).select(F.col("node").alias("a"), F.col("_b.other").alias("b"))
    roots = groups_of(best)
    placed = full.join(roots, "node", "left").select("field_name", "name", "n", "initials", "kind", F.coalesce("root", "node").alias("organisation"))
    placed = checkpoint(placed)
    spelled = placed.groupBy("field_name", "organisation").agg(F.max_by("initials", F.struct(F.when(F.col("kind") != "", F.col("n")).otherwise(0), "name")).alias("letters"), F.sum("n").alias("_n"))
    heaviest = spelled.groupBy("field_name", "letters").agg(F.max(F.struct("_n", "organisation"))["organisation"].alias("organisation"))
    short = parsed.where("letters <> ''").join(heaviest, ["field_name", "letters"], "left").select("field_name", "name", F.coalesce("organisation", "node").alias("organisation"))
    return placed.select("field_name", "name", "organisation").unionByName(short)


def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, name, n): the distinct texts of companies and institutions and their rows."""
    c = table(spark, sf_dir, "candidates")
    both = F.concat(
        F.transform(F.coalesce(F.col("career_history.company"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("company").alias("field_name"), x.alias("name"))),
        F.transform(F.coalesce(F.col("education.institution"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("institution").alias("field_name"), x.alias("name"))),
    )
    return c.select(F.inline(both)).where("name is not null").groupBy("field_name", "name").agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of different spellings of one organisation.

    Null and blank texts and null lists or entries are no spellings; a text on many rows is one spelling; very
    long texts are parsed whole; an empty table gives no pairs. No other column of the table is read.
    """
    linked = checkpoint(linked_names(typed_names(spark, sf_dir)))
    return pairs_within(linked, ["field_name", "organisation"], "name").select("field_name", F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def p3_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a spelling: its organisation's most frequent spelling and how many spellings that has."""
    names = checkpoint(typed_names(spark, sf_dir))
    linked = checkpoint(linked_names(names).join(names, ["field_name", "name"]))
    heads = linked.groupBy("field_name", "organisation").agg(F.max_by("name", F.struct("n", "name")).alias("organisation_name"), F.count(F.lit(1)).alias("n_spellings"))
    return linked.join(heads, ["field_name", "organisation"]).select("field_name", "name", "organisation_name", "n_spellings")
