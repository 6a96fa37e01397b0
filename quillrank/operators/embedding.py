"""Text vectors by hashed words, and a record's likeness to stated query texts, in its own row.

The embedder is a token lookup with a mean, as a static embedder is, but its table is a hash: a word adds 1 or -1
at one of ``DIM`` places, and the sum is brought to length 1. No weights, no training, the same on every machine.
Another embedder is any function from a list of texts to an array of vectors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64
NORM_EPSILON = 1e-9
SEMANTIC = ["sim_ideal_max", "sim_ideal_mean", "sim_anti_max", "semantic_contrastive", "sim_jd_summary", "per_req_coverage_mean", "per_req_coverage_min", "per_req_coverage_std"]
#: Queries, from the last, that stand for requirements.
REQUIREMENTS = 6
Embedder = Callable[[list[str]], np.ndarray]


@lru_cache(1 << 18)
def _place(word: str) -> tuple[int, int]:
    digits = md5(word.encode()).hexdigest()
    return int(digits[:2], 16) % DIM, 1 if int(digits[2], 16) % 2 else -1


def hashed_vectors(texts: list[str]) -> np.ndarray:
    """(texts, DIM) of length 1 each; zeros for a text without words."""
    out = np.zeros((len(texts), DIM))
    for k, text in enumerate(texts):
        for word in re.findall(r"[a-z0-9]+", (text or "").lower()):
            at, sign = _place(word)
            out[k, at] += sign
    size = np.sqrt((out * out).sum(axis=1))
    return out / np.where(size > 0, size, 1.0)[:, None]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt((v * v).sum(axis=1)) + NORM_EPSILON)[:, None]


def semantic_scores(units: list[np.ndarray], queries: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each record's chunk vectors the eight semantic features, and the cosines of their mean to the nearest wanted and unwanted query."""
    out = np.zeros((len(units), len(SEMANTIC) + 2))
    q = _unit(queries)
    for k, v in enumerate(units):
        if not len(v) or not len(q):
            continue
        cos = _unit(v) @ q.T
        ideal = cos[:, wanted] if wanted.any() else np.zeros((len(v), 1))
        anti = cos[:, ~wanted].max() if (~wanted).any() else 0.0
        cover = cos[:, -REQUIREMENTS:].max(axis=0)
        pooled = (_unit(v.mean(axis=0, keepdims=True)) @ q.T)[0]
        near = pooled[wanted] if wanted.any() else pooled
        far = pooled[~wanted].max() if (~wanted).any() else 0.0
        out[k] = [ideal.max(), ideal.mean(), anti, ideal.max() - 0.4 * anti, cos[:, 0].max(), cover.mean(), cover.min(), cover.std(), near.max(), far]
    return out


def semantic(chunks: Column, queries: list[str], n_wanted: int, embed: Embedder = hashed_vectors) -> Column:
    """struct of the eight features, ``dense_score`` and ``anti_score`` of an array of texts; zeros for a null or empty array.

    The first ``n_wanted`` queries are wanted, the others not. Queries become vectors once a task.
    """
    names = [*SEMANTIC, "dense_score", "anti_score"]

    def run(parts: pd.Series) -> pd.DataFrame:
        texts = [[] if p is None else list(p) for p in parts]
        flat = embed([t for p in texts for t in p])
        ends = np.cumsum([0, *map(len, texts)])
        vectors = embed(queries)
        wanted = np.arange(len(queries)) < n_wanted
        return pd.DataFrame(semantic_scores([flat[a:b] for a, b in zip(ends, ends[1:])], vectors, wanted), columns=names)

    return F.pandas_udf(run, "struct<" + ",".join(f"{n}:double" for n in names) + ">")(chunks)
