"""A snapshot as one plan: records, retained records, aspects, with a content digest."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.digests import digest_of
from provlake.model import Policy
from provlake.operators import compose, explain
from provlake.sources import results


@dataclass
class Snapshot:
    """Lazy frames of the claims at an evaluation time (by default the last receive time)."""

    claims: DataFrame
    policy: Policy
    evaluated: Column | None = None
    authority: DataFrame | None = None
    restart_epoch: int = 0
    restart_count: int = 0

    @cached_property
    def records(self) -> DataFrame:
        return compose.claim_records(self.claims, self.policy, self.evaluated, self.authority)

    @cached_property
    def retained(self) -> DataFrame:
        return compose.retained(self.records)

    @cached_property
    def aspects(self) -> DataFrame:
        return compose.aspect_states(self.retained, self.policy)

    @property
    def parents(self) -> DataFrame:
        return compose.parents(self.aspects)

    def refreshed(self, *times: Column) -> DataFrame:
        """The aspects at several evaluation times, numbered by at."""
        records = compose.claim_records(self.claims, self.policy, authority=self.authority, times=list(times))
        return compose.aspect_states(compose.retained(records), self.policy)

    def header(self) -> DataFrame:
        """One row: generation, epoch, evaluated and the watermarks of time."""
        at = F.col("received_max") if self.evaluated is None else self.evaluated
        return compose.high_water(self.claims).select(F.col("high").alias("generation"), F.col("high_epoch").alias("epoch"), at.alias("evaluated"), "observed_max", "received_max", "received_min", F.lit(self.restart_epoch).cast("long").alias("restart_epoch"), F.lit(self.restart_count).cast("long").alias("restart_count"))

    def subject(self, name: str) -> DataFrame:
        """The aspects of one subject; none where it has no evidence."""
        return self.aspects.where(F.col("subject") == name)

    def aspect(self, subject: str, name: str) -> DataFrame:
        return self.subject(subject).where(F.col("aspect") == name)

    def source(self, name: str) -> DataFrame:
        """The summary of one source."""
        return compose.source_summary(self.claims.where(F.col("source") == name), self.policy, F.lit(0)).drop("freshness")

    def subjects(self, claims: bool = True, conflicts: bool = True) -> DataFrame:
        """One nested row for each subject, with or without the claims and conflicts of its aspects."""
        groups = compose.conflict_groups(self.retained) if conflicts else None
        return results.subjects(self.aspects, self.retained if claims else None, groups)

    def summary(self) -> DataFrame:
        """subject, aspect, place, key, line: the snapshot as lines of text; in order of the first four they are the text
        itself. Fixed texts."""
        return explain.summary(self.aspects, self.retained, compose.conflict_groups(self.retained))

    def content(self) -> DataFrame:
        """part, key, line: what the digest covers, as text: the aspects of subjects, their retained claims, sources."""
        text = lambda *c: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("~")) if not isinstance(x, str) else F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in c])
        aspects = self.aspects.select(F.lit("aspect").alias("part"), F.col("subject").alias("key"), text("aspect", "truth", "agreed", "fresh_sources", "need_sources", "best_authority", "need_authority").alias("line"))
        claims = self.retained.select(F.lit("claim").alias("part"), F.col("subject").alias("key"), text("aspect", "source", "incarnation", "sequence", "value", "supported", "is_current", "freshness", "observed_at", "received_at").alias("line"))
        sources = compose.source_summary(self.claims, self.policy, F.lit(0)).select(F.lit("source").alias("part"), F.col("source").alias("key"), text("records", "last_sequence", "current", "boots").alias("line"))
        return aspects.unionByName(claims).unionByName(sources)

    def digest(self) -> DataFrame:
        """snapshot_id: SHA-256 over the header and the digests of what the snapshot holds (see digest_of)."""
        head = self.header().select(F.concat_ws("|", *["generation", "epoch", "evaluated", "observed_max", "received_max", "received_min"]).alias("head"))
        made = digest_of(self.content())
        return made.crossJoin(F.broadcast(head)).select(F.concat(F.lit("snap:"), F.sha2(F.concat_ws("|", "head", "digest"), 256)).alias("snapshot_id"))
