"""Quality rules: base counts, then repetition by suffix arrays.

The words of a piece of texts are sorted by suffix (prefix doubling, from three words on, among suffixes that are not
yet alone). Neighbours in that order give the longest-common-prefix intervals; the interval around a suffix is the
longest maximal repeated substring that begins there. The union of those spans and the longest of them are limited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provlake.llm._shared import Words, dense, packed, per_text, pieces, spans_id

#: The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Base rules: fewer words fail, and so does a larger share (in percent) of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Repetition: a repeat has at least this many words; this share of the words may be covered, and one repeat may be
#: this share of the words, or this many words in any case.
REPEAT_WORDS, MAX_COVERED, MAX_LONGEST, LONGEST_FREE = 8, 0.3, 0.2, 60

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def repeats(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word: whether it is in a 3-word window found twice or more in its text, and the words of the longest
    substring, of three or more, that begins there and is in its text twice or more."""
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 4:
        return np.zeros(n, bool), longest
    text = words.text
    one = dense(words.id)
    base = int(one.max()) + 1
    rank1 = dense(text * base + one)
    room = n + 1

    def joined(left: np.ndarray, ahead: int, right: np.ndarray) -> np.ndarray:
        """Keys of left here and right that many words ahead in the same text; nothing there comes first."""
        key = left * room
        ok = np.flatnonzero(text[ahead:] == text[:-ahead])
        key[ok] += right[ok + ahead] + 1
        return key

    rank2 = dense(joined(rank1, 1, rank1))
    key = joined(rank2, 2, rank1)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    whole = np.zeros(n, bool)
    whole[np.flatnonzero(text[2:] == text[:-2])] = True
    shared = ~new | np.append(~new[1:], False)
    twice = np.zeros(n, bool)
    twice[order[shared]] = True
    twice &= whole
    edge = np.zeros(n + 3, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 3, -1)
    covered = np.cumsum(edge)[:n] > 0
    if not len(at):
        return covered, longest
    # prefix doubling; order holds the suffixes, those of a group that are equal so far side by side
    levels = [(1, rank1), (2, rank2), (3, rank.copy())]
    slots = np.flatnonzero(shared & twice[order])
    base_slots, h = slots, 3
    while len(slots):
        here = order[slots]
        key = rank[here] * room
        ok = (here + h < n) & (text[np.minimum(here + h, n - 1)] == text[here])
        key[ok] += rank[here[ok] + h] + 1
        by = np.argsort(key, kind="stable")
        here, key = here[by], key[by]
        order[slots] = here
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[here] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2
        slots = slots[~new | np.append(~new[1:], False)]
        if len(slots):
            levels.append((h, rank.copy()))
    # common prefixes of neighbours, from the largest power down
    left, right = order[base_slots[:-1]], order[base_slots[1:]]
    near = (np.diff(base_slots) == 1) & (levels[2][1][left] == levels[2][1][right])
    left, right = left[near], right[near]
    common = np.zeros(len(left), np.int64)
    for h, level in reversed(levels):
        a, b = left + common, right + common
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = inside & (text[a] == text[left]) & (text[b] == text[right]) & (level[a] == level[b])
        # a level's rank says that h words are equal only where h words are left, or both end there
        room_a, room_b = words.first[text[left] + 1] - a, words.first[text[right] + 1] - b
        same &= (room_a >= h) & (room_b >= h)
        common[same] += h
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return covered, longest


def count(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of packed texts, by name."""
    words = Words(data, at)
    n = len(data)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = letters[words.end] - letters[words.start]
    covered, longest = repeats(words)
    # lines that hold a word and equal an earlier one of the text
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([at[:-1], breaks + 1]))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    filled = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[filled], ends[filled]
    owner = np.searchsorted(at, starts, "right") - 1
    line = dense(spans_id(data, starts, ends))
    key = np.sort(owner * (len(line) + 1) + line)
    dup = key[1:][key[1:] == key[:-1]] // (len(line) + 1)
    # repeats long enough, as spans
    m = len(words)
    edge = np.zeros(m + 1, np.int64)
    long = np.flatnonzero(longest >= REPEAT_WORDS)
    np.add.at(edge, long, 1)
    np.add.at(edge, long + longest[long], -1)
    most = np.zeros(len(at) - 1, np.int64)
    np.maximum.at(most, words.text, longest)
    values = (words.count, per_text(chars, words.first), per_text(SYMBOLS[data], at), np.bincount(dup, minlength=len(at) - 1), per_text(covered, words.first), per_text(np.cumsum(edge)[:m] > 0, words.first), most)
    return dict(zip(COUNTS, values))


def verdict(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rules fail, and whether the text is kept."""
    n = found["n_words"]
    failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    longest = found["longest_repeat"]
    repeated = (found["n_covered_words"] > MAX_COVERED * n) | ((longest > LONGEST_FREE) & (longest > MAX_LONGEST * n))
    return failed, ~failed & ~repeated


def _ruled(place: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = packed(batch.column(place))
            for a, b in pieces(at):
                found = count(data[at[a] : at[b]], at[a : b + 1] - at[a])
                columns = [pa.array(found[c], pa.int64()) for c in COUNTS] + [pa.array(x) for x in verdict(found)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], names=names)

    return run


def quality_rules(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns of documents, with the counts of COUNTS, base_failed and kept.

    Null and empty texts have no words, so the base rules fail and they are not kept. Very long texts are taken
    whole. Rows are judged one by one: repeated rows get the same verdict, an empty table gives an empty one. Columns
    that already have a new column's name are replaced.
    """
    new = [*COUNTS, "base_failed", "kept"]
    frame = documents.drop(*[c for c in documents.columns if c.lower() in new and c != text])
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema)
    added = ", ".join(f"{c} long" for c in COUNTS)
    return frame.mapInArrow(_ruled(frame.columns.index(text), [*frame.columns, *new]), f"{fields}, {added}, base_failed boolean, kept boolean")
