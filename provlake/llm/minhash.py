"""Near-duplicate classes by DartMinHash.

A document is the weighted set of its five-word shingles; the weight is the number of times it has the shingle, but
any real weights work. For each shingle darts fall on the plane of weight and rank, one per unit of area on average, the
same in every document. The plane is cut into regions that double in weight and in rank, these into cells of an area of
one at most, and a cell's darts follow from a hash: how many, where, and which of K coordinates each belongs to. Of the
darts below a document's weight of the shingle, those below a rank that is set by its total weight are thrown; the one
of the smallest rank in each coordinate is the signature. Two documents agree in a coordinate with a probability of
their weighted Jaccard similarity, the sum of minima over the sum of maxima of the weights.

Bands of the signature give candidates. Links are exact: a candidate pair counts where its similarity, computed from
the whole texts, reaches the threshold. Classes are the connected components of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._shared import Words, mix, packed, pieces, saved

#: Words of a shingle; least similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and rows of a band: a pair at 0.8 shares a band with a probability of 0.9997, at 0.5 of 0.33.
BANDS, ROWS = 26, 6
COORDINATES = BANDS * ROWS
#: Mean number of darts of a document; with fewer, coordinates stay empty more often and the cut is doubled.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 2))
#: Signatures that agree in fewer coordinates aren't looked at more closely: at 0.8, five standard deviations below.
AGREE = int(COORDINATES * (SIMILAR - 5 * (SIMILAR * (1 - SIMILAR) / COORDINATES) ** 0.5))
#: Counts of units of weight by hash; the sum of minima bounds what two texts share from above.
COUNTS = 512
#: Texts of one side of a tile, about.
CHUNK = 256
#: The lowest region of rank ends here, and that of weight at 1; each further one is as wide as all below it.
LOWEST = 0.25
#: Bytes of text of one step.
STEP = 1 << 19

_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit id of each shingle; a text of 1 to n - 1 words has one, of all its words."""
    m = len(words)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ids = np.zeros(m, np.uint64)
    for k in range(n):
        last = m - k
        if last <= 0:
            break
        same = words.text[k:] == words.text[:last]
        ids[:last] += np.where(same, mix(words.id[k:] + np.uint64((k + 1) * int(_C) % 2**64)), np.uint64(0))
    size = words.count[words.text]
    place = np.arange(m) - words.first[:-1][words.text]
    full = (place + n <= size) | ((place == 0) & (size < n))
    return words.text[full], mix(ids[full])


def _same(text: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which the occurrences of a shingle in a text are together, and where each shingle begins."""
    key = mix(ids ^ mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    return order, np.append(True, key[order[1:]] != key[order[:-1]])[: len(ids)]


def units(text: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of the units of weight: a shingle's second occurrence in a text is another unit, and so on."""
    order, new = _same(text, ids)
    nth = np.empty(len(ids), np.uint64)
    nth[order] = (np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))).astype(np.uint64)
    return mix(ids + nth * np.uint64(0xD1342543DE82EF95))


def weighted(text: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, id and number of occurrences of each different shingle of a text."""
    order, new = _same(text, ids)
    first = np.flatnonzero(new)
    return text[order[first]], ids[order[first]], np.diff(np.append(first, len(ids))).astype(np.float64)


def _poisson(mean: float) -> np.ndarray:
    """Probabilities of at most 0, 1, ... darts in a cell."""
    k = np.arange(24)
    return np.cumsum(np.exp(-mean) * mean**k / np.append(1.0, np.cumprod(k[1:].astype(np.float64))))


def _part(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from hashes."""
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def darts(ids: np.ndarray, weight: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Element, coordinate and rank of the darts below each element's weight and cut, region by region."""
    heavy, wide, v = 0.0, 1.0, 0
    while len(some_v := np.flatnonzero(weight > heavy)):
        low, high, j = 0.0, LOWEST, 0
        while len(some := some_v[cut[some_v] > low]):
            cells = max(1, int(wide * (high - low)))
            step = (high - low) / cells
            need = np.minimum(np.ceil((cut[some] - low) / step).astype(np.int64), cells) if cells > 1 else np.ones(len(some), np.int64)
            element = np.repeat(some, need)
            cell = np.arange(len(element)) - np.repeat(np.cumsum(need) - need, need)
            seed = mix(ids[element] + np.uint64((v * 4096 + j * 64 + 1) * int(_C) % 2**64) + cell.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            number = np.searchsorted(_poisson(wide * step), _part(seed), "right")
            hit = np.flatnonzero(number)
            number = number[hit]
            at = np.repeat(hit, number)
            nth = (np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number) + 1).astype(np.uint64)
            dart = mix(seed[at] + nth * _C)
            rank = low + (cell[at] + _part(dart)) * step
            mine = element[at]
            other = mix(dart ^ _C)
            inside = rank < cut[mine]
            if (weight[some] < heavy + wide).any():
                inside &= heavy + wide * _part(other) < weight[mine]
            yield mine[inside], (mix(other[inside]) % np.uint64(COORDINATES)).astype(np.int64), rank[inside]
            low, high, j = high, 2 * high, j + 1
        heavy, wide, v = heavy + wide, wide if v == 0 else 2 * wide, v + 1


def signatures(text: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n rows of COORDINATES ranks; a text without weight has infinities. Each shingle of a text is there once, with a
    weight above 0; weights well below 1 cost more darts."""
    out = np.full(n * COORDINATES, np.inf)
    total = np.bincount(text, weight, n)
    cut = DARTS / np.maximum(total, 1e-300)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        left = np.zeros(n, bool)
        left[todo] = True
        some = left[text]
        owner = text[some]
        for mine, place, rank in darts(ids[some], weight[some], cut[owner]):
            np.minimum.at(out, owner[mine] * COORDINATES + place, rank)
        todo = todo[np.isinf(out.reshape(n, COORDINATES)[todo]).any(axis=1)]
        cut[todo] *= 2
    return out.reshape(n, COORDINATES)


def counts(text: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """n rows of COUNTS numbers of units by hash, 255 for 255 or more."""
    place = (unit % np.uint64(COUNTS)).astype(np.int64)
    return np.minimum(np.bincount(text * COUNTS + place, minlength=n * COUNTS), 255).astype(np.uint8).reshape(n, COUNTS)


def may_reach(one: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Whether one row of counts and each of others allow a similarity of least; always true for counts of 255."""
    shared = np.minimum(one, others).sum(axis=1, dtype=np.int64)
    whole = others.sum(axis=1, dtype=np.int64) + int(one.sum(dtype=np.int64)) - shared
    return (shared / np.maximum(whole, 1) >= least) | (others.max(axis=1, initial=0) == 255) | (one.max() == 255)


def _signed() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = packed(batch.column(2))
            for a, b in pieces(at, STEP):
                words = Words(data[at[a] : at[b]], at[a : b + 1] - at[a])
                text, ids = shingles(words)
                sig, held = signatures(*weighted(text, ids), b - a), counts(text, units(text, ids), b - a)
                bits = mix(sig.view(np.uint64))
                bands = np.zeros((b - a, BANDS), np.uint64)
                for k in range(ROWS):
                    bands = mix(bands + bits[:, k::ROWS] * np.uint64(2 * k + 1))
                bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _C).view(np.int64)
                short = (bits & np.uint64(0xFFFF)).astype(np.uint16)
                rows = np.flatnonzero(np.isfinite(sig[:, 0]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(bands[rows].ravel()))
                known = [batch.column(k).slice(a, b - a).take(pa.array(rows)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*known, lists, pa.array([short[r].tobytes() for r in rows], pa.binary()), pa.array([held[r].tobytes() for r in rows], pa.binary())], names=["doc", "whole", "bands", "short", "counts"])

    return run


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts, pair by pair."""
    out = []
    (ld, la), (rd, ra) = packed(left), packed(right)
    for a, b in pieces(la + ra, 2 * STEP):
        lt, li = shingles(Words(ld[la[a] : la[b]], la[a : b + 1] - la[a]))
        rt, ri = shingles(Words(rd[ra[a] : ra[b]], ra[a : b + 1] - ra[a]))
        both = np.bincount(lt, minlength=b - a) + np.bincount(rt, minlength=b - a)
        # units that both sides have are the sum of minima
        key = np.concatenate([units(lt, li) ^ mix(lt.astype(np.uint64)), units(rt, ri) ^ mix(rt.astype(np.uint64))])
        order = np.argsort(key)
        twice = order[:-1][key[order[1:]] == key[order[:-1]]]
        owner = np.concatenate([lt, rt])
        shared = np.bincount(owner[twice], minlength=b - a)
        out.append(shared / np.maximum(both - shared, 1))
    return np.concatenate(out) if out else np.zeros(0)


def _linked(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = similarities(batch.column(2), batch.column(3)) >= least
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in (0, 1)], names=["a", "b"])

    return run


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: each node's edge to its smallest neighbour where that is smaller,
    and edges between the ends that those stand for.

    In a large class whose members are linked to the same few texts the second kind all but vanishes, and its rows are
    counted once before they are joined by the linked text.
    """
    ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = saved(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("low")), "low")
    once = saved(edges.join(low.hint("merge"), F.col("a") == F.col("node")).select(F.col("low").alias("x"), "b").distinct(), "once")
    between = once.join(low.hint("merge"), F.col("b") == F.col("node")).where("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b")).distinct()
    return low.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).union(between)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of edges (a, b); no edge has equal ends.

    Each round takes the smallest label among neighbours, then labels of labels; rounds end when none changes. The
    labels of each round are a written table.
    """
    edges = saved(contracted(edges), "contracted")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = saved(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), "label"), "least")
        # the label's own label is at least as small
        jumped = least.join(least.select(F.col("node").alias("n"), F.col("next").alias("far")), F.col("next") == F.col("n")).select("node", F.least("next", "far").alias("next"), "label")
        jumped = saved(jumped, "jumped")
        labels = jumped.select("node", F.col("next").alias("label"))
        if jumped.where("next <> label").isEmpty():
            return labels


def _links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    with_a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    with_b = with_a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_linked(least), "a long, b long")


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, n_links: for every row of documents its class, named by the smallest id in it, and how many
    different texts its text was linked to while classes were found.

    Rows with equal ids are one document: it is in the class of each of its texts, and its links are judged by the first
    of them in byte order. A text without words is like no other, and so is a row with a null id; such a row's class is
    its own id (null for null). Texts of fewer than five words are alike only if their words are equal. An empty table
    gives an empty one; other columns are left out.

    Equal texts (by a 64-bit hash) stand for each other from the start. In each bucket of a band every text is compared
    with the one that shares most buckets with others, summed over its bands, and with one drawn by hash. Where a
    bucket still holds several classes after that, texts outside the class of the bucket's first are compared, in tiles
    of two chunks, with the members of other classes; a chunk of the bucket is a key, so a large bucket is many. So pairs
    within one class are not enumerated, and no two texts of a bucket stay apart untested; signatures that agree in
    fewer than AGREE coordinates count as tested, and so do texts whose counts of shingles by hash rule the similarity
    out. Joins don't broadcast, as all tables here grow with the documents.
    """
    docs = documents.select(F.col(id).cast("long").alias("doc"), F.xxhash64(text).alias("whole"), F.col(text).alias("text"))
    signed = saved(docs.where("doc is not null and text is not null").mapInArrow(_signed(), "doc long, whole long, bands array<long>, short binary, counts binary"), "signatures")
    firsts = saved(signed.groupBy("whole").agg(F.min("doc").alias("rep")), "firsts")
    first = signed.join(firsts.withColumnRenamed("whole", "w"), (F.col("whole") == F.col("w")) & (F.col("doc") == F.col("rep"))).dropDuplicates(["whole"])
    reps = saved(first.select("rep", "whole", "bands", "short", "counts"), "reps")
    members = reps.select("rep", "whole", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(members.join(sizes.hint("merge"), "band"), "shared")
    # a text whose buckets are the fullest is near the middle of its class
    ranked = shared.join(shared.groupBy("rep").agg(F.sum("n").alias("rank")).hint("merge"), "rep")
    leaders = ranked.groupBy("band").agg(F.max_by("rep", F.struct("rank", -F.col("rep"))).alias("leader"), F.min_by("rep", F.xxhash64("rep", "band")).alias("other"))
    buckets = saved(shared.join(leaders.hint("merge"), "band"), "buckets")
    pairs = buckets.select(F.col("rep").alias("a"), F.explode(F.array("leader", "other")).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    needed = buckets.select(F.col("rep").alias("doc"), "whole").distinct()
    texts = saved(docs.join(needed.hint("merge"), ["doc", "whole"], "left_semi").groupBy("doc").agg(F.min("text").alias("text")), "texts")
    links = saved(_links(pairs, texts, least), "links")
    labels = components(links)

    # buckets that hold several classes: chunks of texts outside the first's class meet chunks of the bucket
    short = reps.select("rep", "short", "counts")
    label = lambda name, out: labels.select(F.col("node").alias(name), F.col("label").alias(out))
    placed = saved(buckets.join(label("rep", "l").hint("merge"), "rep", "left").join(label("leader", "m").hint("merge"), "leader", "left").select("band", "rep", "leader", F.ceil(F.col("n") / CHUNK).alias("parts"), F.coalesce("l", "rep").alias("class"), F.coalesce("m", "leader").alias("first")), "placed")
    mixed = placed.where("class <> first").select("band").distinct()
    inside = placed.where("rep <> leader").join(mixed.hint("merge"), "band", "left_semi").join(short.hint("merge"), "rep")
    chunks = inside.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("home", F.col("class") == F.col("first"))
    chunks = saved(chunks.groupBy("band", "home", "chunk").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("rep", "class", "short", "counts")).alias("texts")), "chunks")
    # a chunk goes to each chunk of its bucket, so the bucket is as many keys as it has chunks
    rest = chunks.where("not home").select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("chunk"), F.col("texts").alias("left"))
    near = rest.join(chunks.select("band", "chunk", "home", F.col("texts").alias("right")).hint("merge"), ["band", "chunk"]).select("home", "left", "right").mapInArrow(_agreeing(least), "a long, b long").distinct()
    more = saved(_links(near, texts, least), "more-links")
    every, found = links, not more.isEmpty()
    if found:
        every = saved(links.union(more).distinct(), "all-links")
        labels = components(every)

    degree = every.select("a").union(every.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n"))
    known = firsts.join(labels, F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("a"), "left").select("whole", F.coalesce("label", "rep").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
    classed = saved(signed.select("doc", "whole").join(known, "whole").groupBy("doc").agg(F.min("label").alias("label"), F.max("n").alias("n")), "classes")
    return docs.select("doc").join(classed.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"), "left").select(F.col("doc").alias("doc_id"), F.coalesce("label", "doc").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def _agreeing(least: float) -> Callable:
    """Pairs of different classes, once each, whose signatures agree in AGREE coordinates or more and whose counts allow
    a similarity of least; by tiles of chunks."""

    def side(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        short = np.frombuffer(b"".join(r["short"] for r in rows), np.uint16).reshape(-1, COORDINATES)
        held = np.frombuffer(b"".join(r["counts"] for r in rows), np.uint8).reshape(-1, COUNTS)
        return np.array([r["rep"] for r in rows], np.int64), np.array([r["class"] for r in rows], np.int64), short, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                (a, class_a, short_a, held_a), (b, class_b, short_b, held_b) = side(tile["left"]), side(tile["right"])
                for k in range(len(a)):
                    some = np.flatnonzero((class_b != class_a[k]) & (tile["home"] | (a[k] < b)))
                    some = some[(short_b[some] == short_a[k]).sum(axis=1) >= AGREE]
                    good = b[some[may_reach(held_a[k], held_b[some], least)]]
                    if len(good):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), a[k])), pa.array(good)], names=["a", "b"])

    return run


def one_of_each(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the first of their class, one row for each id; rows with a null id all stay. Of rows of one
    id the first by text stays, then by the JSON of the other columns."""
    classes = near_duplicates(documents, id, text).where("doc_id = class_id").select(F.col("doc_id").alias(id)).distinct()
    other = F.to_json(F.struct(*[F.col(c) for c in documents.columns if c not in (id, text)], F.lit(1).alias("_")))
    kept = documents.join(saved(classes, "kept"), id, "left_semi").select(*documents.columns)
    kept = kept.groupBy(F.col(id).alias("_id")).agg(F.min_by(F.struct(*documents.columns), F.struct(F.coalesce(text, F.lit("")), other)).alias("_row")).select("_row.*")
    return kept.unionByName(documents.where(F.col(id).isNull()))
