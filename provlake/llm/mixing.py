"""Mixing to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Each cell of source, language and topic has a probability, the product of a factor of each, but 1 at most, such that
the tokens that are kept have the target shares of every source, language and topic. The bound is part of the fitting:
a cell that reaches it is kept whole, and the factors of the other cells make up for what it can't give. A share that
the wanted fraction doesn't allow, since a group hasn't that many tokens, is cut to all that the group has, and the
rest is divided among the others.

The cells are rows of one Spark table, one for each source; the factors of languages and topics are small vectors of
checked size. A round is one aggregation: each source's factor follows from the others, and the sums by language and
topic give theirs. Where there are more pairs of language and topic than that, all factors are written tables, joined
to the cells, and a round updates one after the other.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.llm._shared import named, saved, uniform

#: Without targets, shares are taken to this power and made to sum to one: below one, small groups gain.
TEMPERATURE = 0.8
#: Share of all tokens that the sample has.
FRACTION = 0.8
#: Rounds stop when no share is off by more than this part of itself, or at their number, with a warning.
CLOSE, ROUNDS = 1e-3, 60
#: Most pairs of language and topic whose factors are vectors; beyond these they are tables. Most cells or factors that
#: are broadcast; beyond these the join is salted. Cells of one value that meet in a task of such a join of factors.
MOST_PAIRS, MOST_BROADCAST, SALTS, TOGETHER = 1_000, 100_000, 64, 100_000
#: Parts of [0, 1) by which the tokens of a cell are counted, so that its kept part can be cut to measure.
PARTS = 256
SEED = 20_240_501


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column, words: Column) -> Column:
    """A coarse topic by form: fixed rules on counts of characters, a stand-in for a topic column or model."""
    count = lambda letters: F.regexp_count(text, F.lit(f"[{letters}]"))
    return F.when(words == 0, "empty").when(count("|") * 5 >= words, "tabular").when(count("#*$%&<>!") * 4 >= words, "symbols").when(count("0-9") * 20 >= F.char_length(text), "numeric").when(words < 100, "short").otherwise("prose")


def _level(wanted: float, total: float, sums: Callable[[float], tuple[float, float]]) -> float:
    """The number x for which the sum of the smaller of own and x times share is wanted; infinite if there is none.
    sums(x): own of the groups that x times their share reaches, and share of the others."""
    x = wanted / total if total > 0 else math.inf
    for _ in range(100):
        held, open_ = sums(x)
        if open_ <= 0:
            return math.inf
        if (new := (wanted - held) / open_) <= x * (1 + 1e-12):
            return x
        x = new
    return x


def _filled(own: np.ndarray, share: np.ndarray, wanted: float) -> np.ndarray:
    x = _level(wanted, float(share.sum()), lambda x: (float(own[own <= x * share].sum()), float(share[own > x * share].sum())))
    return np.where(share > 0, np.minimum(own, x * share) if math.isfinite(x) else own, 0.0)


def _filled_table(frame: DataFrame, wanted: float) -> DataFrame:
    """frame (own, share) with target."""

    def sums(x: float) -> tuple[float, float]:
        reached = F.col("own") <= x * F.col("share")
        row = frame.agg(F.sum(F.when(reached, F.col("own")).otherwise(0.0)), F.sum(F.when(reached, 0.0).otherwise(F.col("share")))).first()
        return row[0] or 0.0, row[1] or 0.0

    x = _level(wanted, frame.agg(F.sum("share")).first()[0] or 0.0, sums)
    return frame.withColumn("target", F.when(F.col("share") > 0, F.least("own", x * F.col("share")) if math.isfinite(x) else F.col("own")).otherwise(0.0))


def _step(held: np.ndarray, open_: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What the factors of an axis are multiplied by: held is the tokens of cells at their bound, open_ of the others."""
    now = held + open_
    down = np.divide(target, now, out=np.zeros(len(now)), where=now > 0)
    up = np.divide(target - held, open_, out=np.ones(len(now)), where=open_ > 0)
    return np.where(now > target, down, up)


def _own(owner: np.ndarray, w: np.ndarray, r: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The factor of each source: what its cells, w times the smaller of 1 and factor times r, need to give target.
    Newton steps from below; the sum is concave in the factor, so none goes too far."""
    n = len(target)
    total = np.bincount(owner, w * r, n)
    a = np.divide(target, total, out=np.zeros(n), where=total > 0)
    for _ in range(100):
        full = a[owner] * r >= 1
        held, slope = np.bincount(owner[full], w[full], n), np.bincount(owner[~full], (w * r)[~full], n)
        new = np.divide(target - held, slope, out=a.copy(), where=slope > 1e-300)
        if (new <= a * (1 + 1e-12)).all():
            break
        a = np.maximum(a, new)
    return a


def _round(b: np.ndarray, c: np.ndarray, sums: bool) -> Callable:
    """With sums the tokens by language and topic, at their bound and below it; else the cells with their probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            cells = lists.flatten()
            l, t, w = (np.array(cells.field(k)) for k in range(3))
            owner = np.repeat(np.arange(batch.num_rows), np.array(lists.value_lengths(), np.int64))
            r = b[l] * c[t]
            p = np.minimum(_own(owner, w, r, np.array(batch.column(1), np.float64))[owner] * r, 1.0)
            if sums:
                at, size = l * len(c) + t, len(b) * len(c)
                held, open_ = np.bincount(at, np.where(p >= 1, w, 0), size), np.bincount(at, np.where(p >= 1, 0, w * p), size)
                some = np.flatnonzero(np.bincount(at, minlength=size))
                yield pa.RecordBatch.from_arrays([pa.array((some // len(c)).astype(np.int32)), pa.array((some % len(c)).astype(np.int32)), pa.array(held[some]), pa.array(open_[some])], names=["l", "t", "held", "open"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(l), pa.array(t), pa.array(w), pa.array(p)], names=["source", "l", "t", "w", "probability"])

    return run


def _warn(off: float) -> None:
    if off > CLOSE:
        warnings.warn(f"mixing: the targets can't all be met or need more rounds; the worst share is off by {off:.3%} of itself", stacklevel=3)


def _by_vectors(cells: DataFrame, pairs: list, wanted: float, sources: DataFrame | None, langs: dict | None, topics: dict | None) -> tuple[DataFrame, float]:
    """source, lang, topic, w (share of all tokens), probability of the cells with tokens, and how far a share is off."""
    key = lambda x: (x is not None, x)
    lang_names, topic_names = sorted({p["lang"] for p in pairs}, key=key), sorted({p["topic"] for p in pairs}, key=key)
    total = sum(p["tokens"] for p in pairs)
    own = np.zeros((len(lang_names), len(topic_names)))
    for p in pairs:
        own[lang_names.index(p["lang"]), topic_names.index(p["topic"])] += p["tokens"] / total
    share = lambda own, names, asked: own**TEMPERATURE if asked is None else np.array([float(asked.get(n, 0.0)) for n in names])
    share_l, share_t = share(own.sum(1), lang_names, langs), share(own.sum(0), topic_names, topics)

    def index(c: str, names: list) -> Column:
        # null is the first of the names
        known = [n for n in names if n is not None]
        place = F.array_position(F.lit(known), F.col(c)) + (len(names) - len(known) - 1) if known else F.lit(0)
        return F.when(F.col(c).isNull(), 0).otherwise(place).cast("int")

    entry = F.struct(index("lang", lang_names).alias("l"), index("topic", topic_names).alias("t"), (F.col("tokens") / total).alias("w"))
    by_source = cells.where("tokens > 0").groupBy("source").agg(F.collect_list(entry).alias("cells"), (F.sum("tokens") / total).alias("own"))
    if sources is None:
        by_source = by_source.withColumn("share", F.pow("own", F.lit(TEMPERATURE)))
    else:
        asked = sources.select(F.col("source").alias("s"), F.col("share").cast("double").alias("share"))
        by_source = by_source.join(asked, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, ["share"])
    by_source = saved(by_source, "mix-sources")
    reach = [by_source.where("share > 0").agg(F.sum("own")).first()[0] or 0.0, own.sum(1)[share_l > 0].sum(), own.sum(0)[share_t > 0].sum()]
    wanted = min(wanted, *map(float, reach))
    target_l, target_t = _filled(own.sum(1), share_l, wanted), _filled(own.sum(0), share_t, wanted)
    rows = _filled_table(by_source, wanted).select("source", "target", "cells")

    b, c, off = np.ones(len(lang_names)), np.ones(len(topic_names)), 0.0
    for _ in range(ROUNDS):
        held, open_ = np.zeros(own.shape), np.zeros(own.shape)
        for r in rows.mapInArrow(_round(b, c, True), "l int, t int, held double, open double").groupBy("l", "t").agg(F.sum("held").alias("held"), F.sum("open").alias("open")).collect():
            held[r["l"], r["t"]], open_[r["l"], r["t"]] = r["held"], r["open"]
        both = held + open_
        off = max(np.divide(np.abs(x - t), t, out=np.zeros(len(t)), where=t > 0).max(initial=0.0) for x, t in ((both.sum(1), target_l), (both.sum(0), target_t)))
        if off < CLOSE:
            break
        up = _step(held.sum(1), open_.sum(1), target_l)
        b, open_ = b * up, open_ * up[:, None]
        c = c * _step(held.sum(0), open_.sum(0), target_t)
    _warn(off)
    source = f"`source` {cells.schema['source'].dataType.simpleString()}"
    fitted = rows.mapInArrow(_round(b, c, False), f"{source}, l int, t int, w double, probability double")
    name = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), F.col(i))
    return saved(fitted.select("source", name(lang_names, "l").alias("lang"), name(topic_names, "t").alias("topic"), "w", "probability"), "mix-cells"), float(off)


def _by_tables(cells: DataFrame, wanted: float, sources: DataFrame | None, langs: dict | None, topics: dict | None) -> tuple[DataFrame, float]:
    """What _by_vectors gives, for any number of values: the factors of each axis are a written table."""
    spark, axes = cells.sparkSession, ("source", "lang", "topic")
    counted = cells.where("tokens > 0")
    total = float(counted.agg(F.sum("tokens")).first()[0])
    rows = counted.select(*axes, (F.col("tokens") / total).alias("w"))
    asked = {"source": None if sources is None else sources.select("source", F.col("share").cast("double").alias("asked"))}
    for c, given in (("lang", langs), ("topic", topics)):
        kind = cells.schema[c].dataType.simpleString()
        asked[c] = None if given is None else spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{c} {kind}, asked double")

    own, small = {}, {}
    for c in axes:
        by = rows.groupBy(F.col(c).alias("k")).agg(F.sum("w").alias("own"), F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
        if asked[c] is None:
            by = by.withColumn("share", F.pow("own", F.lit(TEMPERATURE)))
        else:
            by = by.join(asked[c], F.col("k").eqNullSafe(F.col(c)), "left").withColumn("share", F.coalesce("asked", F.lit(0.0)))
        own[c] = saved(by.select("k", "salts", "own", "share"), "mix-own")
        wanted = min(wanted, own[c].where("share > 0").agg(F.sum("own")).first()[0] or 0.0)
        small[c] = own[c].count() <= MOST_BROADCAST
        if not small[c]:
            # values with many cells are few, however many cells there are
            hot = own[c].where("salts > 1").select("k", "salts")
            rows = rows.join(F.broadcast(hot), F.col(c).eqNullSafe(F.col("k")), "left").withColumn(f"salt_{c}", F.pmod(F.xxhash64(*axes), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("k", "salts")
    rows = saved(rows, "mix-cells")
    factor = {c: saved(_filled_table(own[c], wanted).select("k", "salts", "target", F.lit(1.0).alias("f")), "mix-factor") for c in axes}

    def fit() -> DataFrame:
        """The cells with r, the product of their factors."""
        frame = rows.withColumn("r", F.lit(1.0))
        for c in axes:
            side = factor[c].select("k", "salts", "f")
            if small[c]:
                joined = frame.join(F.broadcast(side), F.col(c).eqNullSafe(F.col("k")), "left")
            else:
                side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                joined = frame.join(side, F.col(c).eqNullSafe(F.col("k")) & (F.col(f"salt_{c}") == F.col("salt")), "left")
            frame = joined.withColumn("r", F.col("r") * F.col("f")).select(*frame.columns)
        return frame

    off = math.inf
    for _ in range(ROUNDS):
        worst = 0.0
        for c in axes:
            full = F.col("r") >= 1
            by = fit().groupBy(F.col(c).alias("at")).agg(F.sum(F.when(full, F.col("w")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w") * F.col("r"))).alias("open"))
            now = F.col("held") + F.col("open")
            up = F.when(now > F.col("target"), F.col("target") / now).when(F.col("open") > 0, (F.col("target") - F.col("held")) / F.col("open")).otherwise(1.0)
            away = F.when(F.col("target") > 0, F.abs(now - F.col("target")) / F.col("target")).otherwise(0.0)
            new = saved(factor[c].join(by, F.col("k").eqNullSafe(F.col("at")), "left").select("k", "salts", "target", (F.col("f") * up).alias("f"), away.alias("away")), "mix-factor")
            worst = max(worst, new.agg(F.max("away")).first()[0] or 0.0)
            factor[c] = new.drop("away")
        off = worst
        if off < CLOSE:
            break
    _warn(off)
    return saved(fit().select(*axes, "w", F.least(F.lit(1.0), "r").alias("probability")), "mix-fitted-cells"), float(off)


def calibrate(cells: DataFrame, sources: DataFrame | None = None, langs: dict | None = None, topics: dict | None = None, fraction: float = FRACTION) -> DataFrame:
    """source, lang, topic, weight, probability, off of each cell (source, lang, topic, tokens).

    tokens times probability has the target shares of every source, language and topic, and is the wanted fraction of
    all tokens; probability is 1 at most. weight is probability over its mean by tokens. sources: source, share; langs,
    topics: shares by value, which need not sum to one. A target that is more than all tokens of a value is cut to
    these, and the others get the rest by their shares; values without a target share get probability 0, and the
    fraction is less where those with one have less. null is a value of its own. Cells without tokens get weight and
    probability 1. There may be any number of sources, languages and topics.

    off: by what part of itself the worst target share of a language or topic is missed in the mean. It is below CLOSE,
    unless the targets contradict each other or ROUNDS were too few; then there is a warning too.
    """
    pairs = cells.where("tokens > 0").groupBy("lang", "topic").agg(F.sum("tokens").cast("double").alias("tokens")).limit(MOST_PAIRS + 1).collect()
    none = cells.where("tokens is null or tokens <= 0") if pairs else cells
    none = none.select("source", "lang", "topic", F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"), F.lit(0.0).alias("off"))
    if not pairs:
        return none
    fitted, off = _by_tables(cells, fraction, sources, langs, topics) if len(pairs) > MOST_PAIRS else _by_vectors(cells, pairs, fraction, sources, langs, topics)
    mean = fitted.agg(F.sum(F.col("w") * F.col("probability"))).first()[0] or 1.0
    return fitted.select("source", "lang", "topic", (F.col("probability") / mean).alias("weight"), "probability", F.lit(off).alias("off")).unionByName(none)


def _cuts(frame: DataFrame, side: DataFrame, names: dict[str, str], u: str) -> DataFrame:
    """side (the cells by names, probability) with cut: documents with u below it have probability's part of the tokens.

    Tokens are counted by PARTS of u; the part in which the wanted sum is reached is cut in proportion. So a cell keeps
    what it is to keep up to some documents, instead of a number of them that varies with its square root.
    """
    own = [F.col(c).alias(n) for c, n in names.items()]
    counted = frame.where("n_tokens > 0").groupBy(*own, F.floor(F.col(u) * PARTS).alias("bin")).agg(F.sum("n_tokens").alias("t"))
    cell = Window.partitionBy(*names.values())
    before = F.sum("t").over(cell.orderBy("bin")) - F.col("t")
    counted = counted.withColumn("before", before).withColumn("all", F.sum("t").over(cell)).withColumnsRenamed({n: n + "_" for n in names.values()})
    equal = F.lit(True)
    for n in names.values():
        equal &= F.col(n).eqNullSafe(F.col(n + "_"))
    goal = F.col("probability") * F.col("all")
    within = F.when(goal <= F.col("before"), F.lit(0.0)).otherwise(F.least(F.lit(1.0), (goal - F.col("before")) / F.col("t")))
    # the last part that is begun ends the cut; 0 where none is
    cut = F.max(F.when(within > 0, (F.col("bin") + within) / PARTS)).alias("cut")
    found = side.join(counted, equal).groupBy(*names.values()).agg(cut).withColumnsRenamed({n: n + "_" for n in names.values()})
    joined = side.join(found, equal, "left").drop(*[n + "_" for n in names.values()])
    return joined.withColumn("cut", F.when(F.col("probability") >= 1, 1.0).otherwise(F.coalesce("cut", F.lit(0.0))))


def mixed(documents: DataFrame, sources: DataFrame | None = None, langs: dict | None = None, topics: dict | None = None, fraction: float = FRACTION, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """The columns of documents (all, or those named), with topic, n_tokens, weight, probability, off and kept.

    Tokens are words `[^\\x20\\x09-\\x0D]+`; for weight, probability and off see calibrate. A number in [0, 1) follows
    from a document's id and the seed; each cell keeps the documents below a cut, which is set where their tokens are
    probability times the cell's. Repeated rows of an id and cell share their fate, and null ids are told apart by their
    texts. Null and empty texts have no tokens: they are in the cell 'empty' of their source and language, with weight
    and probability 1. Null is a source or language of its own. An empty table gives an empty one. Columns that already
    have a new column's name are replaced. The texts are read once; what is needed of them is written.
    """
    new = ("topic", "n_tokens", "weight", "probability", "off", "kept")
    frame = documents.drop(*[c for c in documents.columns if c.lower() in new])
    wanted = [c for c in frame.columns if columns is None or c in columns]
    u = named(frame, "u")
    text = F.coalesce("text", F.lit(""))
    chance = F.when(F.col("doc_id").isNotNull(), uniform(F.col("doc_id"), seed=seed)).otherwise(uniform(text, seed=seed))
    frame = frame.withColumn("n_tokens", n_words(text)).withColumn("topic", topic(text, F.col("n_tokens"))).withColumn(u, chance)
    frame = saved(frame.select(*dict.fromkeys([*wanted, "source", "lang"]), "topic", "n_tokens", u), "mix-documents")
    cells = saved(frame.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), "mix-counts")
    names = {c: named(frame, "cell", c) for c in ("source", "lang", "topic")}
    side = saved(_cuts(frame, calibrate(cells, sources, langs, topics, fraction).withColumnsRenamed(names), names, u), "mix-fitted")
    equal = F.lit(True)
    for c, n in names.items():
        equal &= F.col(c).eqNullSafe(F.col(n))
    cut = named(frame, "cut")
    side = side.withColumnRenamed("cut", cut)
    if side.count() <= MOST_BROADCAST:
        joined = frame.join(F.broadcast(side), equal, "left")
    else:
        salt = named(frame, "salt")
        other = salt + "_"
        side = side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = frame.withColumn(salt, F.floor(F.col(u) * (SALTS * 1024)).cast("int") % SALTS).join(side, equal & (F.col(salt) == F.col(other)), "left").drop(salt, other)
    return joined.select(*wanted, *new[:-1], (F.col(u) < F.col(cut)).alias("kept"))


def shares(made: DataFrame) -> DataFrame:
    """axis, value, tokens, calibrated, kept of the rows that mixed gave: the shares of a source, language or topic
    among all tokens, among what is kept in the mean, and among what is kept."""
    n, cell = F.col("n_tokens"), ("source", "lang", "topic")
    sums = made.groupBy(*cell).agg(F.sum(n).alias("t"), F.sum(n * F.col("probability")).alias("p"), F.sum(F.when(F.col("kept"), n).otherwise(0)).alias("k"))
    every = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("value")) for c in cell])).alias("a"), "t", "p", "k")
    by = every.groupBy("a.axis", "a.value").agg(*[F.sum(c).alias(c) for c in "tpk"])
    total = by.where("axis = 'topic'").agg(*[F.sum(c).alias("all_" + c) for c in "tpk"])
    return by.crossJoin(F.broadcast(total)).select("axis", "value", *[F.try_divide(F.col(c), F.col("all_" + c)).alias(n) for c, n in zip("tpk", ("tokens", "calibrated", "kept"))])
