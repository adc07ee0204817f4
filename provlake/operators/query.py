"""Filters over a snapshot: kinds, domains, truths, aspect, subtree; the bound, its flag and counts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.digests import digest_of, headed
from provlake.model import DEPTH, DOMAINS, KINDS, TRUTH
from provlake.operators import hierarchy


class Unsupported(ValueError):
    """A filter names a kind, domain or truth that isn't there."""


@dataclass(frozen=True)
class Filter:
    kind: str | None = None
    domains: tuple[str, ...] = field(default=())
    truths: tuple[str, ...] = field(default=())
    aspect: str | None = None
    limit: int | None = None

    @staticmethod
    def from_json(text: str | dict) -> Filter:
        """A filter from JSON: kind, domains, truths, aspect, limit (a decimal string or a number). Members of other
        names count for nothing; values of another type are a ValueError, names that aren't there Unsupported."""
        said = json.loads(text) if isinstance(text, str) else text
        if not isinstance(said, dict):
            raise ValueError("a filter is an object")
        one = lambda k: _typed(said, k, str, None)
        some = lambda k, names: tuple(_among(k, v, names) for v in _typed(said, k, list, []))
        limit = said.get("limit")
        if limit is not None and not (isinstance(limit, int | str) and not isinstance(limit, bool) and str(limit).isdecimal()):
            raise ValueError("limit is a number")
        if (kind := one("kind")) is not None:
            _among("kind", kind, KINDS)
        return Filter(kind, some("domains", DOMAINS), some("truths", TRUTH), one("aspect"), None if limit is None else int(limit))

    def of_kind(self) -> Column:
        return F.col("subject").startswith(self.kind + "/") if self.kind else F.lit(True)

    def selects(self) -> Column:
        out = F.lit(True)
        if self.domains:
            out &= F.substring_index("aspect", ".", 1).isin(*self.domains)
        if self.truths:
            out &= F.col("truth").isin(*self.truths)
        if self.aspect:
            out &= F.col("aspect") == self.aspect
        return out


def _typed(said: dict, name: str, kind: type, default):
    value = said.get(name, default)
    if value is not default and not isinstance(value, kind):
        raise ValueError(f"{name} is no {kind.__name__}")
    return value


def _among(what: str, name, names: tuple[str, ...]) -> str:
    if not isinstance(name, str):
        raise ValueError(f"{what} holds a value that is no text")
    if name not in names:
        raise Unsupported(f"{what} has no {name}")
    return name


def run(aspects: DataFrame, wanted: Filter) -> DataFrame:
    """Aspects that pass, of all subjects, or of the first subjects that have any where a limit is given; empty sets
    are no filter, and a limit of 0 is none. What a limit left out is told by header."""
    out = aspects.where(wanted.of_kind() & wanted.selects())
    if not wanted.limit:
        return out
    first = out.select("subject").distinct().orderBy("subject").limit(wanted.limit)
    return out.join(first, "subject", "left_semi")


def header(aspects: DataFrame, wanted: Filter) -> DataFrame:
    """One row of run: scanned_subjects, matched_subjects, matched_aspects, truncated.

    truncated: a subject of the kind comes after the last one within the limit, even if none of its aspects passes;
    scanned counts subjects up to and including that one.
    """
    subjects = aspects.groupBy("subject").agg(F.count_if(wanted.selects()).alias("n")).withColumn("n", F.when(wanted.of_kind(), F.col("n")).otherwise(0))
    counts = lambda: (F.count("*").alias("scanned_subjects"), F.count_if(F.col("n") > 0).alias("matched_subjects"), F.coalesce(F.sum("n"), F.lit(0)).alias("matched_aspects"))
    if not wanted.limit:
        return subjects.agg(*counts()).withColumn("truncated", F.lit(False))
    last = subjects.where("n > 0").orderBy("subject").limit(wanted.limit).agg(F.coalesce(F.max("subject"), F.lit("")).alias("last"), (F.count("*") >= wanted.limit).alias("full"))
    stop = subjects.where(wanted.of_kind()).crossJoin(F.broadcast(last)).where("full and subject > last").agg(F.min("subject").alias("stop"))
    # the subject that stops the scan is counted as scanned, not as matched
    seen = subjects.crossJoin(F.broadcast(stop)).where("stop is null or subject <= stop").withColumn("n", F.when(F.col("subject") == F.col("stop"), 0).otherwise(F.col("n")))
    return seen.agg(*counts(), F.coalesce(F.bool_or(F.col("stop").isNotNull()), F.lit(False)).alias("truncated"))


def subtree(nodes: DataFrame, root: str, depth: int = DEPTH) -> DataFrame:
    """node, depth of all at or below root, by a walk down."""
    return hierarchy.down(nodes, nodes.where(F.col("node") == root).select("node", "kind"), depth).select("node", "depth")


def within(aspects: DataFrame, nodes: DataFrame, root: str, depth: int = DEPTH) -> DataFrame:
    """The aspects of subjects at or below root; a filter like the others, before a limit counts."""
    return aspects.join(subtree(nodes, root, depth + 1).select(F.col("node").alias("subject")), "subject", "left_semi")


def result_digest(rows: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """digest: one row, SHA-256 of the result of run, whatever its order; head: a snapshot's header, whose generation and
    epoch then count too."""
    line = F.concat_ws("|", "aspect", "truth", F.coalesce("agreed", F.lit("~")))
    return headed(digest_of(rows.select(F.lit("aspect").alias("part"), F.col("subject").alias("key"), line.alias("line"))), head)


def last_records(claims: DataFrame, n: int) -> DataFrame:
    """The last n records, in order of arrival."""
    return claims.orderBy(F.desc("arrival_seq")).limit(n).orderBy("arrival_seq")
