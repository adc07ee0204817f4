"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learned by cyclic boosting of shallow trees one feature at a time; then
pairs of features get tables in the same way. A score is the sum of the tables' entries, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._shared import Words, dense, packed, per_text, pieces
from provlake.llm.quality_rules import SYMBOLS, count

#: Most labelled documents that the model learns from: those of the smallest hashes of their ids.
SAMPLE = 20_000
BINS, ROUNDS, PAIRS, PAIR_BINS, PAIR_ROUNDS, RATE = 48, 120, 8, 8, 60, 0.1
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "symbols_per_word", "pipes_per_word", "marks_per_word", "stops_per_word", "commas_per_word", "digits_per_char", "upper_per_char", "wide_per_char",
    "lines_per_word", "dup_lines", "repeated", "covered", "longest", "distinct", "short_words", "long_words", "same_as_before",
)


def _is(letters: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[[ord(c) for c in letters]] = True
    return flags


_PIPE, _MARK, _STOP, _COMMA, _DIGIT, _LINE = map(_is, ("|", "!?", ".", ",", "0123456789", "\n"))
_UPPER = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each packed text; zeros stand for what an empty text has none of."""
    found, words = count(data, at), Words(data, at)
    n, chars = np.maximum(found["n_words"], 1), np.maximum(per_text((data & 0xC0) != 0x80, at), 1)
    sums = lambda flags: per_text(flags[data], at)
    size = words.end - words.start
    by_word = lambda flags: per_text(flags, words.first)
    # capitals of two bytes: C3 80 to C3 9E
    second = np.zeros(len(data), bool)
    if len(data):
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    key = np.sort(words.text * (len(words) + 1) + dense(words.id))
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount(key[fresh] // (len(words) + 1), minlength=len(at) - 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words.id[1:] == words.id[:-1]) & (words.text[1:] == words.text[:-1])
    lines = sums(_LINE) + 1
    columns = (
        np.log1p(found["n_words"]), found["word_chars"] / n, sums(SYMBOLS) / n, sums(_PIPE) / n, sums(_MARK) / n, sums(_STOP) / n, sums(_COMMA) / n, sums(_DIGIT) / chars, (sums(_UPPER) + per_text(second, at)) / chars, per_text((data & 0xC0) == 0x80, at) / chars,
        lines / n, found["n_dup_lines"] / lines, found["n_repeat_words"] / n, found["n_covered_words"] / n, found["longest_repeat"] / n, distinct / n, by_word(size <= 3) / n, by_word(size >= 14) / n, by_word(same) / n,
    )
    return np.column_stack(columns)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over the bins of one feature, from sums of gradients and of second derivatives by bin."""
    out = np.zeros(len(gradient))
    todo = [(0, len(gradient), depth)]
    while todo:
        a, b, left = todo.pop()
        g, h = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
        out[a:b] = g[-1] / (h[-1] + 1)
        if left and b - a > 1:
            gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
            cut = int(np.argmax(gain)) + 1
            todo += [(a, a + cut, left - 1), (a + cut, b, left - 1)]
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a grid into four, as leaf values over the grid, and its gain."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, at = -1.0, (0, 0)
    parts = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
    gain = sum(x**2 / (y + 1) for x, y in zip(parts(g), parts(h)))
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[at] - g[-1, -1] ** 2 / (h[-1, -1] + 1))
    out = np.empty_like(gradient)
    for (x, y), gs, hs in zip(((0, 0), (0, 1), (1, 0), (1, 1)), parts(g), parts(h)):
        rows = slice(0, at[0] + 1) if x == 0 else slice(at[0] + 1, None)
        cols = slice(0, at[1] + 1) if y == 0 else slice(at[1] + 1, None)
        out[rows, cols] = gs[at] / (hs[at] + 1)
    return out, best


class Additive:
    """Tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape if len(x) else (0, len(FEATURES))
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
        self.coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
        share = np.clip(y.mean(), 0.01, 0.99) if n else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        if not n:
            return
        bins = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)]
        score = np.full(n, self.base)
        for _ in range(ROUNDS):
            for f in range(k):
                p = _sigmoid(score)
                size = len(self.tables[f])
                step = RATE * _tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size))
                self.tables[f] += step
                score += step[bins[f]]
        coarse = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.coarse)]
        shape = [len(c) + 1 for c in self.coarse]

        def grid(a: int, b: int) -> tuple[np.ndarray, float, np.ndarray]:
            p, at = _sigmoid(score), coarse[a] * shape[b] + coarse[b]
            sums = [np.bincount(at, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in (y - p, p * (1 - p))]
            return *_quadrants(*sums), at

        able = [(a, b) for a, b in combinations(range(k), 2) if shape[a] > 1 and shape[b] > 1]
        chosen = sorted(able, key=lambda ab: (-grid(*ab)[1], ab))[:PAIRS]
        for ab in chosen:
            self.pairs[ab] = np.zeros((shape[ab[0]], shape[ab[1]]))
        for _ in range(PAIR_ROUNDS):
            for ab in chosen:
                step, _, at = grid(*ab)
                self.pairs[ab] += RATE * step
                score += RATE * step.ravel()[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, x[:, f], "left")]
        for (a, b), values in self.pairs.items():
            total += values[np.searchsorted(self.coarse[a], x[:, a], "left"), np.searchsorted(self.coarse[b], x[:, b], "left")]
        return _sigmoid(total)


def _mapped(place: int, names: list[str], make: Callable[[np.ndarray], list[pa.Array]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = packed(batch.column(place))
            for a, b in pieces(at):
                x = features(data[at[a] : at[b]], at[a : b + 1] - at[a])
                kept = [c for k, c in enumerate(batch.slice(a, b - a).columns) if k != place]
                yield pa.RecordBatch.from_arrays([*kept, *make(x)], names=names)

    return run


def _list(x: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))]


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """A model of labels (doc_id, quality 0 or 1) on documents (doc_id, text), learned from at most sample labels.

    Rows with a null id or another quality are not used; of repeated labels of an id the largest counts. Without any
    label every score is 0.5. Of repeated rows of a document the one of the smallest features counts, so at most sample
    rows come to the driver.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = joined.mapInArrow(_mapped(2, ["doc_id", "quality", "x"], _list), "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x")).toArrow().sort_by("doc_id").to_pydict()
    return Additive(np.array(rows["x"], np.float64).reshape(-1, len(FEATURES)), np.array(rows["quality"], np.float64))


def held_out(column: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is divisible by five; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good likelier), predicted (score at THRESHOLD or more).

    Every row of documents gets a score from its text alone; null and empty texts have the features of a text without
    words. Repeated rows get equal scores; an empty table gives an empty one. Other columns are left out.
    """
    model = train(documents, labels.where(~held_out()), sample)
    score = lambda x: [pa.array(model.score(x))]
    made = documents.select(F.col("doc_id"), held_out().alias("held_out"), "text").mapInArrow(_mapped(2, ["doc_id", "held_out", "score"], score), "doc_id long, held_out boolean, score double")
    return made.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
