"""Byte-level BPE encoding and decoding.

The lowest-rank, leftmost merge comes from the root of a segment tree over the ranks of adjacent pairs; each merge
changes three leaves. Distinct pre-tokens are merged once and kept in a bounded table, as words repeat. Short ones are
merged many at a time, each by its own tree, a row of one array; a longer one has a tree to itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._shared import packed, pieces, ragged

#: White space, and the split of byte-level BPE, as its tokenizer states them.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens that a Python worker keeps with their ids at a time, and the longest that it keeps, in characters.
KEPT, KEPT_CHARS = 500_000, 64
#: Bytes up to which pre-tokens are merged many at a time.
WIDE = 64

_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is printable, else the next free from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Merger:
    """A vocabulary: merge ranks by pair of ids, the bytes of each id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = [len(strings.get(i, b"")) for i in range(max(strings) + 1)]
        self.size = np.array(size, np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings.get(i, b"") for i in range(len(size))), np.uint8)
        self.known = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        self.byte_ids, self.base = np.array(self.byte_id), len(strings) + 1
        keys = np.array([a * self.base + b for a, b in self.pairs], np.int64)
        ranks, made = np.array(list(self.pairs.values()), np.int64).T
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], ranks[order]
        self.made = np.zeros(int(ranks.max()) + 1, np.int64)
        self.made[ranks] = made

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        pairs = self.pairs
        width = 1 << (n - 2).bit_length()
        # a leaf is rank * 2^32 + place, so the root is the leftmost lowest rank
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            if found := pairs.get((ids[i], ids[i + 1])):
                tree[width + i] = found[0] << 32 | i
        for i in range(width - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            i = width + leaf
            if tree[i] == value:
                return
            tree[i] = value
            while i > 1:
                low = tree[i ^ 1]
                i >>= 1
                if value < low:
                    low = value
                if tree[i] == low:
                    return
                tree[i] = value = low

        while (root := tree[1]) != _NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                before[k] = i
                found = pairs.get((ids[i], ids[k]))
                put(i, found[0] << 32 | i if found else _NONE)
            else:
                put(i, _NONE)
            if (h := before[i]) >= 0:
                found = pairs.get((ids[h], ids[i]))
                put(h, found[0] << 32 | h if found else _NONE)
        return [x for x in ids if x >= 0]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair is among the merges, and whether it is."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def merge_many(self, raw: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pre-tokens of at most width bytes (a power of two)."""
        n = len(raw)
        size = np.array([len(r) for r in raw], np.int64)
        step = width + 1  # the last place of a row stands for "no neighbour"
        symbols = np.full((n, step), -1, np.int64)
        symbols[np.arange(step) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        after = np.tile(np.arange(1, step + 1), (n, 1))
        after[np.arange(n), size - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), _NONE, np.int64)
        at, has = self._pair(symbols[:, :-2], symbols[:, 1:-1])
        has &= symbols[:, 1:-1] >= 0
        tree[:, width : 2 * width - 1] = np.where(has, self.rank[at] << 32 | np.arange(width - 1), _NONE)
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        S, A, B, T = symbols.ravel(), after.ravel(), before.ravel(), tree.ravel()

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            T[rows + node] = value
            for _ in range(width.bit_length() - 1):
                node >>= 1
                T[rows + node] = np.minimum(T[rows + 2 * node], T[rows + 2 * node + 1])

        active = np.arange(n)
        while True:
            root = tree[active, 1]
            go = root != _NONE
            active, root = active[go], root[go]
            if not len(active):
                break
            row, top = active * step, active * (2 * width)
            i = root & 0xFFFFFFFF
            j = A[row + i]
            made = self.made[root >> 32]
            S[row + i] = made
            S[row + j] = -1
            k = A[row + j]
            A[row + i] = k
            B[row + k] = i
            h = B[row + i]
            put(top, j, np.full(len(j), _NONE))
            right = S[row + k]
            at, has = self._pair(made, right)
            put(top, i, np.where(has & (right >= 0), self.rank[at] << 32 | i, _NONE))
            some = np.flatnonzero(h != width)
            at, has = self._pair(S[row[some] + h[some]], made[some])
            put(top[some], h[some], np.where(has, self.rank[at] << 32 | h[some], _NONE))
        kept = symbols[:, :-1] >= 0
        ids = symbols[:, :-1][kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, tokens: list[str]) -> None:
        """Merge pre-tokens and keep them."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for token in tokens:
            raw = token.encode()
            width = max(2, 1 << (len(raw) - 1).bit_length())
            by_width.setdefault(width, []).append((token, raw))
        for width, some in by_width.items():
            if width > WIDE:
                self.known.update((t, np.array(self.merge(r), "<u4").tobytes()) for t, r in some)
                continue
            part = (1 << 18) // width
            for a in range(0, len(some), part):
                self.known.update(zip([t for t, _ in some[a : a + part]], self.merge_many([r for _, r in some[a : a + part]], width)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special strings have their own ids."""
        found = _split().findall
        cut: list[list[str]] = []
        for text in texts:
            if any(s in text for s in self.special):
                parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
                cut.append([t for k, part in enumerate(parts) for t in ([part] if k % 2 else found(part))])
            else:
                cut.append(found(text))
        every = set().union(*cut)
        if len(self.known) + len(every) > KEPT:
            self.known = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        new = list(every.difference(self.known))
        self.learn(new)
        known = self.known
        out = [b"".join(map(known.__getitem__, tokens)) for tokens in cut]
        for token in new:
            if len(token) > KEPT_CHARS:
                del known[token]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return self.bytes[ragged(self.begin[ids], self.size[ids])].tobytes()


@lru_cache(1)
def _split():
    return regex.compile(SPLIT)


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def _rows(path: str, place: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(path)
        for batch in batches:
            data = batch.column(place)
            at = packed(data)[1]
            for a, b in pieces(at):
                cut = batch.slice(a, b - a)
                ids = model.encode_all([t or "" for t in cut.column(place).to_pylist()])
                every = np.frombuffer(b"".join(ids), "<u4")
                whole = model.decode(every)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                size = np.concatenate([[0], np.cumsum(model.size[every])])[ends]
                texts = [whole[size[k] : size[k + 1]].decode("utf-8", "replace") for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(np.diff(ends), pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=names)

    return run


def bpe_encode(documents: DataFrame, vocabulary: str, text: str = "text", n_tokens: str = "n_tokens", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of documents, with the number of tokens, the ids (little-endian unsigned 32-bit integers in a
    binary) and the text that the ids decode to.

    Null and empty texts have no ids and decode to the empty text. Every row is taken for itself, repeated rows too;
    an empty table gives an empty one. Columns that already have a new column's name are replaced.
    """
    frame = documents.drop(*[c for c in documents.columns if c.lower() in {n_tokens.lower(), ids.lower(), decoded.lower()}])
    fields = ", ".join(f"`{c.replace('`', '``')}` {t.simpleString()}" for c, t in ((f.name, f.dataType) for f in frame.schema))
    return frame.mapInArrow(_rows(vocabulary, frame.columns.index(text), [*frame.columns, n_tokens, ids, decoded]), f"{fields}, `{n_tokens}` long, `{ids}` binary, `{decoded}` string")


def bpe_digest(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    made = bpe_encode(documents.select("doc_id", "text"), vocabulary)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
