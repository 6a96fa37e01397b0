"""p8: encoding of the corpus with a public byte-level BPE tokenizer, by dynamic programming over prefixes.

Byte-pair encoding merges greedily by rank, yet its result for a prefix of a piece is unique and so is that
result's last token: the one vocabulary token that ends the prefix, is itself left whole by the merges, and
may stand behind the last token of what is left. ``last[i]`` stores it for the prefix of i bytes. The ids of
the whole piece follow by walking back. Appending bytes adds entries and changes none; an edit inside keeps
all entries before it, and re-encoding from there stops nothing short of exact.

Two tokens may stand side by side if no merge, taken in rank order while both are rebuilt from their halves,
would join across their border before both are whole.

A text is first cut into pieces by the tokenizer's own pattern, pieces do not merge with each other, and each
distinct piece is encoded once per worker (the store is bounded and emptied when full).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a path, never copied into the package.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the pattern of the byte-level vocabulary's first step.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per worker, and the longest kept, in bytes.
KEPT_PIECES, KEPT_BYTES = 400_000, 64


def _byte_names() -> dict[str, int]:
    """The vocabulary file's character for each byte: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    return names | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class PrefixEncoder:
    """The vocabulary with the halves of each token, and the encoding of one piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names = _byte_names()
        as_bytes = lambda text: bytes(names[c] for c in text)
        vocab: dict[str, int] = model["vocab"]
        self.ids: dict[bytes, int] = {}
        for text, k in vocab.items():
            if all(c in names for c in text):
                self.ids[as_bytes(text)] = k
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank[pair], self.made[pair] = k, whole
            self.halves.setdefault(whole, (*pair, k))
        self.size = {k: len(b) for b, k in self.ids.items()}
        self.longest = max(self.size.values())
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, list[int]] = {}
        self.fits = lru_cache(1 << 18)(self._fits)
        #: Tokens that the merges leave whole; others never occur in an encoding.
        self.whole: dict[bytes, int] = {}
        for b, k in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(b) == 1 or (k in self.halves and self.fits(*self.halves[k][:2], self.halves[k][2])):
                self.whole[b] = k

    def _fits(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """True if no merge of rank below ``before`` joins across the border of two tokens.

        The halves facing the border are opened, the later merge first; of two uses of one merge the left one
        came first. A pair at the border stands until the last opened token was made: a merge of the pair
        with a lower rank would have been taken, and on the right also one of the same rank.
        """
        until = before
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and joined < until:
                return False
            l, r = self.halves.get(left), self.halves.get(right)
            if l is None and r is None:
                return True
            if r is None or (l is not None and l[2] > r[2]):
                until, left = l[2], l[1]
            else:
                until, right = r[2] + 1, r[0]

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fill ``last`` for the prefixes longer than ``start``; those up to it are kept as they are."""
        del last[start + 1 :]
        whole, size, fits, longest = self.whole, self.size, self.fits, self.longest
        for i in range(start + 1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                token = whole.get(data[j:i])
                if token is not None and (j == 0 or fits(last[j], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def walk(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= self.size[last[i]]
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        whole = self.whole.get(data)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(data, last, 0)
        return self.walk(last)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or an empty one. Special tokens' strings are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "surrogatepass")
                ids = self.piece(data)
                if len(data) <= KEPT_BYTES:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


class EditableEncoding:
    """One piece under edits: appends extend the prefix table, an edit re-encodes from its place on."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, [-1]
        encoder.extend(data, self.last, 0)

    def append(self, more: bytes) -> None:
        n = len(self.data)
        self.data += more
        self.encoder.extend(self.data, self.last, n)

    def replace(self, start: int, stop: int, by: bytes) -> None:
        self.data = self.data[:start] + by + self.data[stop:]
        self.encoder.extend(self.data, self.last, start)

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "", counts: bool = False) -> DataFrame:
    """``key`` and ``ids`` (or ``n_tokens`` where ``counts``) of every row; no shuffle.

    Null and empty texts get the empty list (0). Repeated rows come out as often as they came in. Other
    columns are not read. Texts of any length are encoded whole.
    """
    path = path or f"{TOKENIZER_DIR}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            ids = [own.encode(t) for t in b.column(1).to_pylist()]
            out = pa.array(map(len, ids), pa.int32()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], [key, "n_tokens" if counts else "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens int" if counts else "ids array<int>"))
