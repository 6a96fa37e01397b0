"""p7: values typed freely to the entry of a reference list, by token-level repair and soft TF-IDF.

Each distinct token is taken to a word of the reference vocabulary: a known short form, or the nearest word by
edit distance (the vocabulary is a trie, walked with the token's Levenshtein automaton). The repaired tokens
of a value rank the entries that share one by soft TF-IDF, the cosine of both with shared words weighed down by
their edits. Words run together or parted at the wrong place are met by comparing letters without spaces.
An entry is taken where it explains the whole value: seniority, line of business or any other word it lacks
costs that word's weight. Remarks on contract, place, status and legal form carry no weight.

The reference list is small by nature and collected once (``MAX_ENTRIES`` is checked); values are matched once
per distinct text, whatever number of rows has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tables import checkpoint, table, task_count
from quillrank.llm.spellings import LEGAL, PLACES, _squeezed, folded, kind_word, tokens
from quillrank.llm.tries import Trie

MAX_ENTRIES = 100_000
#: The least soft TF-IDF for a match, and the least share of equal letters where words are run together.
ALIKE, RUN_ALIKE = 0.93, 0.85

# Short forms of trades and industries; a form may stand for several words.
SHORT = {
    "current_title": {"sr": "senior", "snr": "senior", "senr": "senior", "jr": "junior", "engg": "engineer", "engr": "engineer", "eng": "engineer", "er": "engineer", "mgr": "manager", "mngr": "manager", "mgmt": "management", "dev": "developer", "devt": "development", "devpt": "development", "tech": "technical", "rep": "representative", "reps": "representative", "sci": "scientist", "exec": "executive", "archt": "architect", "arch": "architect", "sec": "security", "infra": "infrastructure", "ops": "operations", "acct": "accountant", "accts": "accounts", "mech": "mechanical", "elec": "electrical", "elect": "electrical", "admn": "administrator", "admin": "administrator", "spec": "specialist", "acq": "acquisition", "appln": "application", "app": "application", "apps": "application", "programme": "program", "pgm": "program", "prog": "program", "db": "database", "supp": "support", "qa": "quality assurance", "hr": "human resources", "ml": "machine learning", "nlp": "natural language processing", "sre": "site reliability engineer", "dba": "database administrator", "ta": "talent acquisition", "fe": "frontend", "be": "backend", "cv": "computer vision", "mktg": "marketing", "dsgn": "design", "maint": "maintenance", "fin": "financial", "dir": "director", "asst": "assistant"},
    "industry": {"tech": "technology", "svcs": "services", "svc": "services", "srvcs": "services", "mfg": "manufacturing", "govt": "government", "gov": "government", "admin": "administration", "fin": "financial", "ed": "education", "edu": "education", "pharma": "pharmaceuticals", "hr": "human resources", "mgmt": "management", "it": "information technology", "info": "information", "sw": "software", "telecom": "telecommunications", "telecoms": "telecommunications", "telco": "telecommunications", "comm": "commerce", "auto": "automotive", "warehouse": "warehousing", "logistic": "logistics", "agri": "agri", "defense": "defence", "elec": "electronics", "edtech": "education technology", "fintech": "financial technology"},
}
# Remarks on contract, place, status and legal form.
NO_WEIGHT = {
    "current_title": ["freelance", "freelancer", "contract", "contractor", "contractual", "part", "time", "full-time", "ex", "former", "formerly", "currently", "working", "as", "role", "on", "notice", "immediate", "joiner", "open", "to", "work", "at", "in", "for", "of", "and", "the", "permanent", "temporary", "temp", "remote", "hybrid", "onsite", "serving", "available", "position", "job", "title", "present", "current", *PLACES],
    "industry": ["industry", "industries", "sector", "agency", "co", "company", "firm", "business", "field", "domain", "allied", "of", "and", "the", "in", "n", *PLACES],
    "company": ["office", "campus", "branch", "hq", "headquarters", "of", "and", "the", "at", "in", *LEGAL, "p", *PLACES],
}

# Words without weight in a field that has no list of its own (cities, brands, anything else).
NO_WEIGHT_ELSEWHERE = ["of", "and", "the", "a", "an", *LEGAL]
#: Matches that are broadcast at most, and rows of one value that meet in one task beyond that.
FEW_VALUES, ROWS_OF_A_VALUE = 200_000, 100_000
#: Values cut into parts at most, as their list is broadcast; any further ones are left to the planner's skew handling.
MAX_HOT = 100_000


def _most(n: int) -> int:
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 10 else 3


class Reference:
    """The entries of one field: vocabulary, weights, and entries by word, by letters and by initials."""

    def __init__(self, field: str, entries: list[tuple[int, str]]):
        self.field = field
        self.short, self.skip = SHORT.get(field, {}), NO_WEIGHT.get(field, NO_WEIGHT_ELSEWHERE)
        self.words = {ref: self._own(label) for ref, label in entries}
        n_with: dict[str, int] = {}
        for ws in self.words.values():
            for w in set(ws):
                n_with[w] = n_with.get(w, 0) + 1
        n = max(1, len(self.words))
        self.weight = {w: log(1 + n / k) for w, k in n_with.items()}
        self.unknown = log(1 + n)
        self.trie = Trie(self.weight)
        self.by_word: dict[str, list[int]] = {}
        for ref in sorted(self.words):
            for w in set(self.words[ref]):
                self.by_word.setdefault(w, []).append(ref)
        self.norm = {ref: sqrt(sum(self.weight[w] ** 2 for w in set(ws))) for ref, ws in self.words.items()}
        self.runs: dict[str, int] = {}
        self.initials: dict[str, list[int]] = {}
        heads: dict[str, list[int]] = {}
        for ref in sorted(self.words):
            ws = self.words[ref]
            for k in range(len(ws)):
                self.runs.setdefault("".join(ws[k:] + ws[:k]), ref)
            self.initials.setdefault("".join(w[0] for w in ws), []).append(ref)
            proper = [w for w in ws if self._kind(w) is None]
            if field == "company" and proper and len(proper) < len(ws):
                for k in range(len(proper)):
                    heads.setdefault("".join(proper[k:] + proper[:k]), []).append(ref)
        # A company named without its line of business is that entry if there is one of that name only.
        self.heads = {run: refs[0] for run, refs in heads.items() if len(set(refs)) == 1}
        self.short_trie = Trie(w for w in self.short if len(w) >= 4)
        self.remark_trie = Trie(w for w in self.skip if len(w) >= 5)
        self.run_trie = Trie(self.runs)
        self.head_trie = Trie(self.heads)
        self.repair = lru_cache(1 << 18)(self._repair)

    def _kind(self, token: str) -> str | None:
        return kind_word(token, "company") if self.field == "company" else None

    def _own(self, label: str) -> list[str]:
        skip = self.skip
        found = [self._kind(t) or t for t in tokens(label)]
        return [t for t in found if t not in skip] or found

    def _repair(self, token: str) -> tuple[tuple[tuple[str, ...], float], ...]:
        """What a token may stand for: alternatives of (vocabulary words, likeness); none if nothing is near."""
        if token in self.weight:
            return (((token,), 1.0),)
        short = self.short.get(token)
        if short:
            return ((tuple(short.split()), 1.0),)
        kind = self._kind(token)
        if kind:
            return (((kind,), 1.0),)
        n = len(token)
        near = [(d, w) for w, d in self.trie.near(token, _most(n)) if len(w) > 3 and (n > 5 or w[0] == token[0] or n > 3 and d < 2)]
        if near:
            least = min(near)[0]
            return tuple(((w,), 1 - 0.25 * d / max(n, len(w))) for d, w in sorted(near) if d == least)
        cut = [w for w in sorted(self.weight) if n >= 4 and w[0] == token[0] and n < len(w) and _squeezed(token, w)]
        if cut:
            return tuple(((w,), 0.95) for w in cut)
        close = sorted((d, w) for w, d in self.short_trie.near(token, 1) if w[0] == token[0]) if n >= 3 else []
        return tuple((tuple(self.short[w].split()), 0.95) for _, w in close[:1])

    def match(self, value: str) -> int:
        """The entry a value means, 0 if none."""
        inside = re.search(r"\(([^()]*)\)", value)
        if inside:
            # An abbreviation explained in brackets.
            outer = "".join(re.findall(r"[a-z0-9]", folded(value[: inside.start()]).lower()))
            meant = tokens(inside[1])
            if len(outer) >= 2 and outer == "".join(t[0] for t in meant if t not in ("and", "of", "the")):
                value = inside[1]
        text = re.sub(r"\b(\w)[./&](\w)\b(?:[./&](\w)\b)?\.?", lambda m: "".join(g or "" for g in m.groups()) + " ", folded(value))
        letters = re.sub(r"[^A-Za-z]", "", text)
        if self.field == "company" and 2 <= len(letters) <= 6 and (letters.isupper() and " " not in text.strip()):
            refs = self.initials.get(letters.lower(), [])
            return refs[0] if len(refs) == 1 else 0
        skip = self.skip
        found = [t for t in tokens(text) if t not in skip and (len(t) > 1 or t in self.weight)]
        if not found:
            return 0
        meant = [(t, self.repair(t)) for t in dict.fromkeys(found)]
        meant = [(t, m) for t, m in meant if m or not self._is_remark(t)]
        refs = sorted({ref for _, m in meant for words, _ in m for w in words for ref in self.by_word.get(w, ())} if meant else ())
        best = (0.0, 0)
        for ref in refs:
            own, seen, size, shared = set(self.words[ref]), set(), 0.0, 0.0
            for t, m in meant:
                # Of a token's alternatives the one that says most about this entry.
                words, like = max(m, key=lambda x: (sum(w in own for w in x[0]) / len(x[0]), x[1])) if m else ((t,), 0.0)
                for w in words:
                    if w not in seen:
                        seen.add(w)
                        weight = self.weight.get(w, self.unknown) ** 2
                        size += weight
                        shared += like * weight * (w in own)
            score = round(shared / (sqrt(size) * self.norm[ref]), 9)
            if score > best[0]:
                best = (score, ref)
        if best[0] >= ALIKE:
            return best[1]
        order = [w for t, m in meant for w in (m[0][0] if m else (t,))]
        spelled_out = [self.short.get(t, t).replace(" ", "") for t in found]
        for run in dict.fromkeys(["".join(dict.fromkeys(order)), "".join(spelled_out), "".join(found)]):
            hit = self._near_run(run, self.run_trie, self.runs) or self._near_run(run, self.head_trie, self.heads)
            if hit:
                return hit
        return 0

    def _is_remark(self, token: str) -> bool:
        return len(token) >= 5 and any(True for _ in self.remark_trie.near(token, 1))

    def _near_run(self, run: str, trie: Trie, refs: dict[str, int]) -> int:
        edits = min(3, int(len(run) * (1 - RUN_ALIKE)))
        near = [(d, refs[r]) for r, d in trie.near(run, edits)] if len(run) >= 4 else []
        return min(near)[1] if near else 0


def collected(reference: DataFrame) -> dict[str, list[tuple[int, str]]]:
    rows = reference.where("label is not null").select("ref_id", "field_name", "label").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} reference entries")
    out: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        out.setdefault(r["field_name"], []).append((r["ref_id"], r["label"]))
    return out


def matched_values(values: DataFrame, entries: dict[str, list[tuple[int, str]]]) -> DataFrame:
    """(field_name, value, n, ref_id) of distinct (field_name, value, n); 0 where no entry is meant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {f: Reference(f, e) for f, e in entries.items()}
        for pdf in batches:
            refs = [index[f].match(v) if f in index else 0 for f, v in zip(pdf["field_name"], pdf["value"])]
            yield pdf.assign(ref_id=refs)

    return values.select("field_name", "value", "n").mapInPandas(run, "field_name string, value string, n bigint, ref_id int")


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field_name, item_no, value) of every title, company and industry that has a value."""
    c = table(spark, sf_dir, "candidates")
    entry = lambda field, at, value: F.struct(F.lit(field).alias("field_name"), at.cast("int").alias("item_no"), value.alias("value"))
    jobs = F.coalesce(F.col("career_history"), F.array().cast(c.schema["career_history"].dataType))
    every = F.concat(
        F.array(entry("current_title", F.lit(0), F.col("profile.current_title"))),
        F.transform(jobs, lambda j, i: entry("company", i, j["company"])),
        F.transform(jobs, lambda j, i: entry("industry", i, j["industry"])),
    )
    return c.select("record_id", F.inline(every)).where(F.col("value").rlike(r"[^\s\p{Z}]"))


def with_matches(values: DataFrame, matches: DataFrame) -> DataFrame:
    """``values`` with the ``ref_id`` of their (field_name, value) in ``matches``, which has ``n``, its rows.

    Few distinct values are broadcast, behind a count of them. Of more, a value on many rows is met in parts.
    """
    keys = ["field_name", "value"]
    if matches.count() <= FEW_VALUES:
        return values.join(F.broadcast(matches.drop("n")), keys)
    hot = matches.where(F.col("n") > ROWS_OF_A_VALUE).orderBy(F.desc("n")).limit(MAX_HOT).select(*keys, F.ceil(F.col("n") / ROWS_OF_A_VALUE).cast("int").alias("_parts"))
    whole = F.coalesce("_parts", F.lit(1))
    right = matches.drop("n").join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), whole - 1))).drop("_parts")
    left = values.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64("record_id", "item_no"), whole).cast("int")).drop("_parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value that is not exactly a label, with the entry it means or 0.

    Null and blank values and null lists or entries give no row (entries still count for the place of later
    ones); records given twice come out twice; of entries that fit equally the one with the least ref_id is
    taken; without any reference entry every value gets 0; an empty table gives no rows.
    """
    reference = table(spark, sf_dir, "canonical_values")
    entries = collected(reference)
    labels = reference.where("label is not null").select(F.col("label").alias("value")).distinct()
    values = typed_values(spark, sf_dir).join(F.broadcast(labels), "value", "left_anti")
    # Few bytes, much work: the number of tasks is stated, as by size all would be one.
    distinct = checkpoint(values.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))).repartition(task_count(spark), "value")
    matches = checkpoint(matched_values(distinct, entries))
    return with_matches(values, matches).select("record_id", "field_name", "item_no", "ref_id")
