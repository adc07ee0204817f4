"""Exact removal of repeated 50-byte strings by a logarithmic family of suffix arrays.

Documents are packed into blocks. The windows of 50 bytes are dealt to shards by the least hash among the 24-byte
strings inside them, so equal windows meet; runs of windows with the same least hash travel as one piece of text. A
first pass sends hashes alone and finds those that two documents have; only pieces of these are sent.

In a shard, batches of pieces get suffix arrays (prefix doubling, 50 bytes deep) and are merge-scanned against the
existing levels for equal windows; levels of equal size merge, so there are logarithmically many. A window's smallest
document goes back to the blocks, where each document drops what a smaller one has.

Windows whose least hash is found more than HOT times, as in a passage that many documents share, don't go to that
hash's shard: each is dealt by a hash of itself. Its rows come sorted by document, so the first one has the smallest
and the rest are answered as they pass; however many blocks have it, no group holds them.

SuffixIndex keeps the levels as a table in a shared folder and takes further batches of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm._shared import dense, mix, named, packed, per_text, pieces, ragged, saved

#: Bytes of a repeated string, and of the strings inside whose hashes deal windows out.
LENGTH, ANCHOR = 50, 24
WINDOW = LENGTH - ANCHOR + 1
#: Bytes of text in a block and of text that one shard stands for; text of one batch of the index.
BLOCK, SHARD, BATCH = 4 << 20, 2 << 20, 1 << 20
#: Least shards; shards and blocks of a task, about; most tasks of a stage.
LEAST_SHARDS, TOGETHER, MOST_TASKS = 64, 4, 20_000
#: Bits of the hashes that are sent; two strings with equal bits only cost time.
BITS = 48
#: Occurrences of a hash beyond which its windows are dealt one by one.
HOT = 50_000

_LAST = np.iinfo(np.int64).max
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_FACTOR = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and least hash of each run of windows that have one least hash; windows lie
    within one text."""
    out = []
    for a, b in pieces(at, 1 << 19):
        part, base = data[at[a] : at[b]], int(at[a])
        n = len(part)
        if n < LENGTH:
            continue
        h = _TABLE[part]
        h = h[:-1] * _FACTOR[0] + h[1:]
        h = h[:-2] * _FACTOR[1] + h[2:]
        h = h[:-4] * _FACTOR[2] + h[4:]
        wide = h[:-8] * _FACTOR[3] + h[8:]
        h = wide[: n - ANCHOR + 1] * _FACTOR[4] + h[16 : 16 + n - ANCHOR + 1]
        h ^= h >> np.uint64(32)
        h *= _FACTOR[0]
        h ^= h >> np.uint64(29)
        for step in (1, 2, 4, 8):
            h = np.minimum(h[:-step], h[step:])
        h = np.minimum(h[: n - LENGTH + 1], h[WINDOW - 16 : WINDOW - 16 + n - LENGTH + 1])
        # windows that begin in one text and end in the next don't count
        ends = at[a + 1 : b + 1] - base
        owner_end = np.repeat(ends, np.diff(at[a : b + 1]))[: len(h)]
        fine = owner_end - np.arange(len(h)) >= LENGTH
        new = np.empty(len(h), bool)
        new[0] = True
        new[1:] = (h[1:] != h[:-1]) | (fine[1:] != fine[:-1])
        new[ends[:-1][ends[:-1] < len(h)]] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        good = fine[start]
        out.append((start[good] + base, size[good], h[start[good]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _tight(raw: bytes) -> bytes:
    """Compressed, with the size before it."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loose(tight: bytes) -> bytes:
    return pa.decompress(tight[8:], int.from_bytes(tight[:8], "little"), codec="zstd", asbytes=True)


def _short(h: np.ndarray) -> np.ndarray:
    return mix(h) >> np.uint64(64 - BITS)


def _shard(short: np.ndarray, shards: int) -> np.ndarray:
    """Shards of hashes, in their order; there may be up to 2**31."""
    return ((short >> np.uint64(BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _least_of(shard: np.ndarray, shards: int) -> np.ndarray:
    """A number that no hash of the shard is below."""
    return (shard.astype(np.uint64) << np.uint64(32)) // np.uint64(shards) << np.uint64(BITS - 32)


def _bytes_of(shards: int) -> int:
    """Bytes that hold a hash less that number."""
    return -(-(((1 << 32) // shards + 2) << (BITS - 32)).bit_length() // 8)


def _groups(key: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The values of a sorted array with where each begins and ends."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first].tolist(), first.tolist(), [*first[1:].tolist(), len(key)]


def _windows(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The windows that begin at start, as byte strings."""
    return np.ascontiguousarray(text[start[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()


def suffix_array(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that begin at start, in order of their LENGTH bytes, and the rank of each; equal ones share a rank.
    Every window lies within text."""
    n = len(text)
    first = np.zeros(n - 7, np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | text[k : n - 7 + k].astype(np.uint64)
    rank = dense(first)
    for ahead in (8, 16):
        room = len(rank) - ahead
        rank = dense(rank[:room] * (n + 1) + rank[ahead:])
    rank = dense(rank[start] * (n + 1) + rank[start + LENGTH - 32])
    return np.argsort(rank, kind="stable"), rank


class Level:
    """A text with the suffix array of its different windows, and the smallest document of each."""

    def __init__(self, text: np.ndarray, order: np.ndarray, least: np.ndarray):
        self.text, self.order, self.least = text, order, least

    def __len__(self) -> int:
        return len(self.order)

    def scan(self, other: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A merge scan of two suffix arrays: the merged order (places of other come after those of this one), and the
        places here and there of windows that both have. The sort finds two sorted runs and merges them."""
        keys = np.concatenate([_windows(self.text, self.order), _windows(other.text, other.order)])
        merged = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[merged[1:]] == keys[merged[:-1]])
        return merged, merged[same], merged[same + 1] - len(self)

    def share(self, other: Level) -> None:
        """Give both levels the smaller document of each window that both have."""
        _, here, there = self.scan(other)
        both = np.minimum(self.least[here], other.least[there])
        self.least[here] = both
        other.least[there] = both

    def merged(self, other: Level) -> Level:
        order, _, there = self.scan(other)
        least = np.concatenate([self.least, other.least])
        again = np.zeros(len(order), bool)
        again[there + len(self)] = True
        order = order[~again[order]]
        place = np.concatenate([self.order, other.order + len(self.text)])
        return Level(np.concatenate([self.text, other.text]), place[order], least[order])


class Family:
    """Levels of suffix arrays whose sizes grow geometrically."""

    def __init__(self, levels: list[Level] | None = None) -> None:
        self.levels = levels or []

    def add(self, text: np.ndarray, start: np.ndarray, doc: np.ndarray) -> tuple[Level, np.ndarray]:
        """Index the windows at start of documents doc; the batch as a level, and each window's place in it. Equal
        windows of all levels have one smallest document afterwards."""
        order, rank = suffix_array(text, start)
        new = np.flatnonzero(np.append(True, rank[order[1:]] != rank[order[:-1]]))
        batch = Level(text, start[order[new]], np.minimum.reduceat(doc[order], new))
        for _ in range(2 if len(self.levels) > 1 else 1):  # once to learn, once to tell
            for level in self.levels:
                batch.share(level)
        level = Level(batch.text, batch.order, batch.least.copy())
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self.levels.pop().merged(level)
        self.levels.append(level)
        return batch, rank

    def least(self, batch: Level) -> np.ndarray:
        """The smallest document of each window of the batch, over all that was added."""
        now = Level(batch.text, batch.order, batch.least.copy())
        for level in self.levels:
            _, here, there = now.scan(level)
            now.least[here] = np.minimum(now.least[here], level.least[there])
        return now.least


def _pack(place: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = packed(batch.column(place))[1]
            for a, b in pieces(at, BLOCK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    return run


def _unpack(rows: bytes, id_place: int, text_place: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """The rows, their bytes and ends, and their ids; null ids come after all others."""
    batch = pa.ipc.open_stream(rows).read_next_batch()
    data, at = packed(batch.column(text_place))
    ids = np.array(batch.column(id_place).cast(pa.int64()).fill_null(_LAST), np.int64)
    return batch, data, at, ids


def _hashes(data: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different short hashes of a block, in order, which of them two ids have, and their occurrences up to 255."""
    start, _, h = runs(data, at)
    short = _short(h)
    owner = ids[np.searchsorted(at, start, "right") - 1]
    order = np.argsort(short)
    short, owner = short[order], owner[order]
    if not len(short):
        return short, np.zeros(0, bool), np.zeros(0, np.uint8)
    new = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
    return short[new], np.minimum.reduceat(owner, new) != np.maximum.reduceat(owner, new), np.minimum(np.diff(np.append(new, len(short))), 255).astype(np.uint8)


_HASHES = "shard long, block long, hashes binary, twice binary, times binary"


def _send_hashes(shards: int, id_place: int, text_place: int) -> Callable:
    width = _bytes_of(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, data, at, ids = _unpack(rows.as_py(), id_place, text_place)
                short, twice, times = _hashes(data, at, ids)
                shard = _shard(short, shards)
                raw = (short - _least_of(shard, shards)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                some, first, last = _groups(shard)
                spans = list(zip(first, last))
                # most hashes occur once in a block; no counts stand for that
                counts = [times[a:b].tobytes() if times[a:b].max() > 1 else b"" for a, b in spans]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int64()), pa.array(np.full(len(some), block), pa.int64()), pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([np.packbits(twice[a:b]).tobytes() if twice[a:b].any() else b"" for a, b in spans], pa.binary()), pa.array(counts, pa.binary()),
                ], names=["shard", "block", "hashes", "twice", "times"])

    return run


def _shared(width: int, hot: int) -> Callable:
    """For each block which of its hashes two documents have, and which of them occur more than hot times."""

    def run(group: pa.Table) -> pa.Table:
        raw, ends = packed(group.column("hashes"))
        wide = np.zeros((len(raw) // width, 8), np.uint8)
        wide[:, :width] = raw.reshape(-1, width)
        h, ends = wide.view("<u8").ravel(), ends // width
        twice, times = np.zeros(len(h), bool), np.ones(len(h), np.int64)
        for a, b, flags, counts in zip(ends.tolist(), ends[1:].tolist(), group.column("twice"), group.column("times")):
            if len(flags := flags.as_py()):
                twice[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8))[: b - a]
            if len(counts := counts.as_py()):
                times[a:b] = np.frombuffer(counts, np.uint8)
        order = np.argsort(h)
        new = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
        size = np.diff(np.append(new, len(h)))
        several, many = np.zeros(len(h), bool), np.zeros(len(h), bool)
        several[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], new), size)
        many[order] = np.repeat(np.add.reduceat(times[order], new) > hot, size)
        bits = lambda flags: [np.packbits(flags[a:b]).tobytes() if flags[a:b].any() else b"" for a, b in zip(ends.tolist(), ends[1:].tolist())]
        masks = pa.table({"block": group.column("block"), "shard": group.column("shard"), "shared": pa.array(bits(several), pa.binary()), "hot": pa.array(bits(many & several), pa.binary())})
        return masks.filter(pa.array([len(m.as_py()) > 0 for m in masks.column("shared")], pa.bool_()))

    return run


_PIECES = "shard long, block long, text binary, sizes binary, least binary, most binary, which binary, starts binary, window binary, lowest long, highest long"
_PIECE_TYPES = {k: pa.int64() if k in ("shard", "block", "lowest", "highest") else pa.binary() for k in (f.split()[0] for f in _PIECES.split(", "))}


def _distinct(keys: list[bytes], owner: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order of their first, which one each is, and the smallest and largest owner of each."""
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(k, len(place)) for k in keys], np.int64)
    least, most = np.full(len(place), _LAST), np.full(len(place), np.iinfo(np.int64).min)
    np.minimum.at(least, which, owner)
    np.maximum.at(most, which, owner)
    return list(place), which, least, most


def _pieces_of(out: dict[str, list], block: int, data: np.ndarray, at: np.ndarray, ids: np.ndarray, shards: int, several: np.ndarray | None, hot: np.ndarray) -> None:
    """Add a block's rows: for each shard its different pieces (of the hashes in several, if given) and where they are;
    and each different window of the hashes in hot."""
    start, size, h = runs(data, at)
    h = _short(h)
    within = lambda h, some: some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h if len(some) else np.zeros(len(h), bool)
    owner, whole = ids[np.searchsorted(at, start, "right") - 1], data.tobytes()
    many = within(h, hot)

    def add(**values) -> None:
        for k in out:
            out[k].append(values.get(k))

    if many.any():
        each = ragged(start[many], size[many])
        keys, which, least, most = _distinct([whole[a : a + LENGTH] for a in each.tolist()], np.repeat(owner[many], size[many]))
        order = np.argsort(which, kind="stable")
        for k, a, b in zip(*_groups(which[order])):
            add(shard=zlib.crc32(keys[k]) % shards, block=block, window=keys[k], lowest=int(least[k]), highest=int(most[k]), starts=_tight(each[order[a:b]].astype("<u4").tobytes()))
    good = ~many if several is None else within(h, several) & ~many
    start, size, owner, shard = start[good], size[good], owner[good], _shard(h[good], shards)
    order = np.argsort(shard, kind="stable")
    for s, a, b in zip(*_groups(shard[order])):
        mine = order[a:b]
        texts, which, least, most = _distinct([whole[x:y] for x, y in zip(start[mine].tolist(), (start[mine] + size[mine] + LENGTH - 1).tolist())], owner[mine])
        add(shard=s, block=block, text=_tight(b"".join(texts)), sizes=_tight(np.array([len(x) for x in texts], "<u4").tobytes()), least=least.tobytes(), most=most.tobytes(), which=_tight(which.astype("<u4").tobytes()), starts=_tight(start[mine].astype("<u4").tobytes()))


def _send_pieces(shards: int, id_place: int, text_place: int) -> Callable:
    def run(blocks: pa.Table, masks: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in _PIECE_TYPES}
        for block, rows in zip(blocks.column("block").to_pylist(), blocks.column("rows")):
            _, data, at, ids = _unpack(rows.as_py(), id_place, text_place)
            short, _, _ = _hashes(data, at, ids)
            spans = {s: (a, b) for s, a, b in zip(*_groups(_shard(short, shards)))}
            several, hot = np.zeros(len(short), bool), np.zeros(len(short), bool)
            for s, shared, many in zip(*(masks.column(c).to_pylist() for c in ("shard", "shared", "hot"))):
                a, b = spans[s]
                several[a:b] = np.unpackbits(np.frombuffer(shared, np.uint8))[: b - a]
                if many:
                    hot[a:b] = np.unpackbits(np.frombuffer(many, np.uint8))[: b - a]
            if several.any():
                _pieces_of(out, block, data, at, ids, shards, short[several], short[hot])
        return pa.table({k: pa.array(v, _PIECE_TYPES[k]) for k, v in out.items()})

    return run


_FOUND = "block long, starts binary, windows binary, docs binary, lowest long"
_LEVEL = "shard long, level int, text binary, places binary, least binary"


def _index(family: Family, rows: list[dict]) -> dict[str, list]:
    """Add the pieces of several blocks to a family. For each block the runs of windows that a smaller document has than
    one of the block: first byte, number of windows, smallest document."""
    known: dict[bytes, int] = {}
    local, least = [], []
    for row in rows:
        size = np.frombuffer(_loose(row["sizes"]), "<u4").astype(np.int64)
        ends = np.cumsum(size).tolist()
        text = _loose(row.pop("text"))
        local.append(np.array([known.setdefault(text[a:b], len(known)) for a, b in zip([0, *ends], ends)], np.int64))
        least.append(np.frombuffer(row["least"], np.int64))
    smallest = np.full(len(known), _LAST)
    for which, docs in zip(local, least):
        np.minimum.at(smallest, which, docs)
    # a piece that several blocks have is indexed once, with its smallest document
    size = np.array([len(k) for k in known], np.int64)
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(known), np.uint8)
    known.clear()
    batches = []
    windows = size - LENGTH + 1
    for a, b in pieces(np.append(begin, len(text)), BATCH):
        part = text[begin[a] : begin[b - 1] + size[b - 1]]
        start = ragged(begin[a:b] - begin[a], windows[a:b])
        batches.append((*family.add(part, start, np.repeat(smallest[a:b], windows[a:b])), a, b))
    # runs of windows with one smallest document, piece by piece
    found_piece, found_from, found_size, found_doc = [], [], [], []
    for level, rank, a, b in batches:
        doc = (family.least(level) if len(batches) > 1 else level.least)[rank]
        piece = np.repeat(np.arange(a, b), windows[a:b])
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])))
        found_piece.append(piece[new])
        found_from.append(new - (np.cumsum(windows[a:b]) - windows[a:b])[piece[new] - a])
        found_size.append(np.diff(np.append(new, len(doc))))
        found_doc.append(doc[new])
    piece, first, count, doc = (np.concatenate(x) for x in (found_piece, found_from, found_size, found_doc))
    head = np.searchsorted(piece, np.arange(len(size) + 1))
    out: dict[str, list] = {k: [] for k in ("block", "starts", "windows", "docs")}
    for row, mine in zip(rows, local):
        which, starts = (np.frombuffer(_loose(row[k]), "<u4").astype(np.int64) for k in ("which", "starts"))
        of = mine[which]
        each = head[of + 1] - head[of]
        at = ragged(head[of], each)
        some = doc[at] < np.repeat(np.frombuffer(row["most"], np.int64)[which], each)
        if some.any():
            at = at[some]
            begin = np.repeat(starts, each)[some] + first[at]
            for k, v in (("block", row["block"]), ("starts", _tight(begin.astype("<u4").tobytes())), ("windows", _tight(count[at].astype("<u4").tobytes())), ("docs", _tight(doc[at].tobytes()))):
                out[k].append(v)
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What blocks are to lose, of rows in order of shard, window and smallest document. A shard's pieces are indexed
    together. Hot windows pass one by one: the first row of a window has the smallest document of all."""
    shard, held, window, smallest = None, [], None, _LAST
    schema = pa.schema([(k, pa.int64() if k in ("block", "lowest") else pa.binary()) for k in (f.split()[0] for f in _FOUND.split(", "))])

    def index() -> pa.RecordBatch:
        out = _index(Family(), held)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else pa.nulls(len(out["block"]), f.type) for f in schema], schema=schema)

    for batch in batches:
        hot: dict[str, list] = {k: [] for k in ("block", "starts", "lowest")}
        for n in range(batch.num_rows):
            row = {c: batch.column(k)[n].as_py() for k, c in enumerate(batch.schema.names)}
            if held and (row["shard"] != shard or row["window"] is not None):
                yield index()
                held = []
            shard = row["shard"]
            if row["window"] is None:
                held.append(row)
                continue
            if row["window"] != window:
                window, smallest = row["window"], row["lowest"]
            if smallest < row["highest"]:
                for k, v in (("block", row["block"]), ("starts", row["starts"]), ("lowest", smallest)):
                    hot[k].append(v)
        if hot["block"]:
            yield pa.RecordBatch.from_arrays([pa.array(hot[f.name], f.type) if f.name in hot else pa.nulls(len(hot["block"]), f.type) for f in schema], schema=schema)
    if held:
        yield index()


ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


def _cut(id_place: int, text_place: int, names: list[str], as_text: bool) -> Callable:
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for rows in blocks.column("rows"):
            batch, data, at, ids = _unpack(rows.as_py(), id_place, text_place)
            edge = np.zeros(len(data) + 1, np.int32)
            for n in range(found.num_rows):
                row = {c: found.column(c)[n].as_py() for c in ("starts", "windows", "docs", "lowest")}
                begin = np.frombuffer(_loose(row["starts"]), "<u4").astype(np.int64)
                count = np.ones(len(begin), np.int64) if row["windows"] is None else np.frombuffer(_loose(row["windows"]), "<u4").astype(np.int64)
                doc = row["lowest"] if row["docs"] is None else np.frombuffer(_loose(row["docs"]), np.int64)
                gone = doc < ids[np.searchsorted(at, begin, "right") - 1]
                np.add.at(edge, begin[gone], 1)
                np.add.at(edge, begin[gone] + count[gone] + LENGTH - 1, -1)
            removed = np.cumsum(edge)[:-1] > 0
            rise = removed.copy()
            rise[1:] &= ~removed[:-1]
            begins = at[:-1][at[:-1] < len(data)]
            rise[begins] = removed[begins]
            kept, n_removed = data[~removed].tobytes(), per_text(removed, at)
            ends = np.cumsum(np.diff(at) - n_removed).tolist()
            left = [kept[a:b] for a, b in zip([0, *ends], ends)]
            left = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())
            columns = [pa.array(np.diff(at)), pa.array(n_removed), pa.array(per_text(rise, at)), left]
            out.append(pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names))
        return pa.Table.from_batches(out)

    return run


def _cut_by(by_block, found: DataFrame, frame: DataFrame, id_place: int, text_place: int, as_text: bool) -> DataFrame:
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema)
    return by_block.cogroup(found.groupBy("block")).applyInArrow(_cut(id_place, text_place, [*frame.columns, *ADDED], as_text), f"{fields}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def _blocks(documents: DataFrame, id: str, text: str) -> tuple[DataFrame, int, int, DataFrame, int]:
    """documents without names of new columns, the places of id and text, blocks spread over tasks, bytes of all texts."""
    frame = documents.drop(*[c for c in documents.columns if c.lower() in ADDED and c not in (id, text)])
    id_place, text_place = frame.columns.index(id), frame.columns.index(text)
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = min(MOST_TASKS, size // (TOGETHER * BLOCK) + 1)
    return frame, id_place, text_place, frame.mapInArrow(_pack(text_place), "block long, rows binary").repartition(tasks, "block"), size


def suffix_dedup(documents: DataFrame, id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """All columns of documents, with n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that
    remain, as a binary; as_text: as a string, where a character that was cut in two is left out whole.

    A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller id; all is
    judged on the texts as they come. Null and empty texts have no bytes. A row with a null id comes after all others:
    what it shares with them goes, and nothing goes on its account. Rows of equal id take nothing from each other. An
    empty table gives an empty one. Columns that already have a new column's name are replaced.

    One plan, so that all uses of the blocks share their exchange. There are as many shards as the texts' size asks for.
    """
    frame, id_place, text_place, blocks, size = _blocks(documents, id, text)
    shards = max(LEAST_SHARDS, -(-size // SHARD))
    tasks = min(MOST_TASKS, -(-shards // TOGETHER))
    hashes = blocks.mapInArrow(_send_hashes(shards, id_place, text_place), _HASHES).repartition(tasks, "shard")
    masks = hashes.groupBy("shard").applyInArrow(_shared(_bytes_of(shards), HOT), "block long, shard long, shared binary, hot binary")
    by_block = blocks.groupBy("block")
    sent = by_block.cogroup(masks.groupBy("block")).applyInArrow(_send_pieces(shards, id_place, text_place), _PIECES)
    found = sent.repartition(tasks, "shard").sortWithinPartitions("shard", "window", "lowest").mapInArrow(_find, _FOUND)
    return _cut_by(by_block, found, frame, id_place, text_place, as_text)


def suffix_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and SHA-256 of the bytes that remain."""
    return suffix_dedup(documents.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents with what remains of each text; a null text stays null. Columns named like those that suffix_dedup adds
    stay as they are."""
    apart = {c: named(documents, "own", c) for c in documents.columns if c.lower() in ADDED}
    made = suffix_dedup(documents.withColumnsRenamed(apart), as_text=True)
    cut = made.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))).drop(*ADDED)
    return cut.withColumnsRenamed({v: k for k, v in apart.items()}).select(*documents.columns)


def _extended(shards: int) -> Callable:
    """Levels of a shard with the pieces of a new batch added: rows of the new levels, and what each block is to lose."""

    def run(pieces_: pa.Table, levels: pa.Table) -> pa.Table:
        kept = [Level(np.frombuffer(r["text"], np.uint8), np.frombuffer(r["places"], np.int64), np.frombuffer(r["least"], np.int64).copy()) for r in sorted(levels.to_pylist(), key=lambda r: r["level"])]
        family, rows = Family(kept), pieces_.to_pylist()
        shard = (rows or levels.to_pylist())[0]["shard"]
        out = _index(family, rows) if rows else {k: [] for k in ("block", "starts", "windows", "docs")}
        n, m = len(out["block"]), len(family.levels)
        blank = lambda v, kind, before, after: pa.array([None] * before + v + [None] * after, kind)
        columns = {k: blank(v, pa.int64() if k == "block" else pa.binary(), 0, m) for k, v in out.items()}
        columns |= {"lowest": pa.nulls(n + m, pa.int64()), "shard": pa.array([shard] * (n + m), pa.int64()), "level": blank(list(range(m)), pa.int32(), n, 0)}
        columns |= {k: blank(v, pa.binary(), n, 0) for k, v in (("text", [x.text.tobytes() for x in family.levels]), ("places", [x.order.astype(np.int64).tobytes() for x in family.levels]), ("least", [x.least.tobytes() for x in family.levels]))}
        return pa.table(columns)

    return run


class SuffixIndex:
    """The levels of all shards as a table below a shared folder; each batch of documents extends them.

    The number of shards is fixed by the first batch or by shards. A batch writes the levels of all shards anew.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path, self.shards, self.batches = spark, path, shards, 0
        while True:
            try:
                self.shards = spark.read.parquet(f"{path}/batch-{self.batches}").select("shards").first()[0]
            except AnalysisException:
                break
            self.batches += 1

    def levels(self) -> DataFrame:
        """shard, level, text, places, least of the last batch."""
        if not self.batches:
            return self.spark.createDataFrame([], _LEVEL)
        return self.spark.read.parquet(f"{self.path}/batch-{self.batches - 1}").where("level is not null").select(*[f.split()[0] for f in _LEVEL.split(", ")])

    def add(self, documents: DataFrame, id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
        """What suffix_dedup gives for the batch, where strings of documents that were added before count too. Earlier
        results stand: a later document with a smaller id takes nothing from them."""
        frame, id_place, text_place, blocks, size = _blocks(documents, id, text)
        self.shards = self.shards or max(LEAST_SHARDS, -(-size // SHARD))
        shards, tasks = self.shards, min(MOST_TASKS, -(-self.shards // TOGETHER))
        blocks = saved(blocks, "blocks")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out: dict[str, list] = {k: [] for k in _PIECE_TYPES}
                    _, data, at, ids = _unpack(rows.as_py(), id_place, text_place)
                    _pieces_of(out, block, data, at, ids, shards, None, np.zeros(0, np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(v, _PIECE_TYPES[k]) for k, v in out.items()], names=list(out))

        made = blocks.mapInArrow(send, _PIECES).repartition(tasks, "shard").groupBy("shard").cogroup(self.levels().groupBy("shard")).applyInArrow(_extended(shards), f"{_FOUND}, {_LEVEL}")
        made.withColumn("shards", F.lit(shards)).write.option("compression", "zstd").parquet(f"{self.path}/batch-{self.batches}")
        found = self.spark.read.parquet(f"{self.path}/batch-{self.batches}").where("block is not null").select("block", "starts", "windows", "docs", "lowest")
        self.batches += 1
        return _cut_by(blocks.groupBy("block"), found, frame, id_place, text_place, as_text)
