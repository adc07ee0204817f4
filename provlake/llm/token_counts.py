"""Token counts by rank-synchronous merging.

Distinct pre-tokens of a batch are one ragged array of symbols. In each round every pre-token applies its lowest-rank
pair wherever it stands, all pre-tokens at once; those without a pair leave. What survives is counted.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._shared import PIECE
from provlake.llm.bpe import SPACE, byte_letters

#: Fixed value: the split of the vocabulary with word ends.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|" + rf"[^{SPACE}\p{{L}}\p{{N}}]+"
#: Pre-tokens that a Python worker keeps with their counts at a time, and the longest that it keeps, in characters.
KEPT, KEPT_CHARS = 500_000, 64


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, letters, suffix = model["vocab"], byte_letters(), model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.base = len(vocab) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def merged_sizes(self, tokens: list[str]) -> np.ndarray:
        """Symbols left in each pre-token; none is empty."""
        raw = [t.encode() for t in tokens]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[data[ends]]
        out = size.copy()
        alive, owner = np.arange(len(tokens)), np.repeat(np.arange(len(tokens)), size)
        far = len(self.ranks)
        while len(symbols) > 1:
            # the rank of each symbol with the next one of the same pre-token
            rank = np.full(len(symbols), far, np.int64)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pair = symbols[inside] * self.base + symbols[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, pair), far - 1)
            rank[inside] = np.where(self.keys[at] == pair, self.ranks[at], far)
            start = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(symbols)))
            out[alive] = length
            go = low < far
            if not go.any():
                break
            hit = (rank == np.repeat(low, length)) & np.repeat(go, length)
            # in a run of overlapping hits every second one merges, from the left
            where = np.flatnonzero(hit)
            fresh = np.concatenate([[True], (where[1:] != where[:-1] + 1)])
            place = np.arange(len(where)) - np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[place % 2 == 0]
            symbols[where] = self.made[rank[where]]
            stay = np.repeat(go, length)
            stay[where + 1] = False
            symbols, owner, alive = symbols[stay], owner[stay], alive[go]
            if len(symbols):
                owner = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
                out[alive] = np.bincount(owner)
        return out

    def tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of special strings."""
        parts, special = [text], 0
        if "<|" in text:
            special = len(self.cut.findall(text))
            parts = self.cut.split(text)
        out: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                # letter by letter, as the library does: no final sigma
                part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            else:
                part = part.lower()
            out += self.split.findall(part)
        return out, special

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.tokens(t) for t in texts]
        new = list(set().union(*(t for t, _ in cut)).difference(self.known))
        known = self.known
        if len(known) + len(new) > KEPT:
            known = self.known = {}
            new = list(set().union(*(t for t, _ in cut)))
        for a in range(0, len(new), 1 << 16):
            some = new[a : a + (1 << 16)]
            known.update(zip(some, self.merged_sizes(some).tolist()))
        out = [sum(map(known.__getitem__, t)) + n for t, n in cut]
        for t in new:
            if len(t) > KEPT_CHARS:
                del known[t]
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def _counted(path: str, names: list[str], place: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            counts: list[int] = []
            some: list[str] = []
            held = 0
            for text in batch.column(place):
                some.append(text.as_py() or "")
                held += len(some[-1])
                if held > PIECE:
                    counts += model.counts(some)
                    some, held = [], 0
            counts += model.counts(some) if some else []
            kept = [c for k, c in enumerate(batch.columns) if k != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], names=names)

    return run


def token_counts(documents: DataFrame, vocabulary: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """All columns of documents but the text, with the number of its tokens.

    Null and empty texts have none. Every row is taken for itself, repeated rows too; an empty table gives an empty
    one. A column that already has the new column's name is replaced.
    """
    frame = documents.drop(*[c for c in documents.columns if c.lower() == n_tokens.lower() and c != text])
    kept = [f for f in frame.schema if f.name != text]
    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in kept)
    return frame.mapInArrow(_counted(vocabulary, [*(f.name for f in kept), n_tokens], frame.columns.index(text)), f"{fields}`{n_tokens}` long")


def token_report(documents: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, and whether the tokens are more than limit."""
    sized = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(sized, vocabulary).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
