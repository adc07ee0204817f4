"""Admission: observations with any number of claims against the fences, the same step in batch and stream.

What doesn't depend on order is checked in columns; only observations that pass enter the ordered fold of their source.
A fence takes a claim or a whole observation; what it takes stays visible as a rejection or a fenced claim.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.model import ASPECTS, AUTHORITY, SECOND

OUTCOME = "source string, arrival_seq long, disposition string, code string"
ADMITTED = OUTCOME + ", fences array<string>"
SEEN, LEAP = 8, 1_000_000
CLAIMS, SCOPE, NAME_BYTES = 512, 64, 128
#: Rejections and fenced claims that are kept.
RETAINED = 256
ENVELOPE = ["source", "incarnation", "sequence", "generation", "epoch", "observed_at", "received_at", "arrival_seq"]
SAID = ["subject", "aspect", "value", "supported", "revision"]
FOLDED = [*ENVELOPE, "content", "subjects", "aspects", "revisions", "checked", "scope", "high"]


@dataclass
class Lineage:
    """What a source is remembered by."""

    incarnation: str | None = None
    sequence: int = 0
    generation: int = 0
    epoch: int = 0
    content: str = ""
    seen: list[str] = field(default_factory=list)
    revisions: dict[tuple[str, str], int] = field(default_factory=dict)


class Observation(NamedTuple):
    """What the fold needs of one observation."""

    source: str
    incarnation: str
    sequence: int
    generation: int
    epoch: int
    content: str
    scope: list[str] | None
    high: int | None
    subjects: list[str]
    aspects: list[str]
    revisions: list[int]


def step(state: Lineage, o, known: frozenset[str] = frozenset(), boots: int | None = SEEN) -> tuple[str, str, list[str]]:
    """Disposition and code of one observation and the fence of each claim ('' for none); accepted ones advance the
    state. known: aspects that may be claimed, if not empty. boots: how many a source is remembered by; None for all."""
    none = [""] * len(o.subjects)
    if state.incarnation is not None:
        if o.incarnation != state.incarnation:
            if o.incarnation in state.seen:
                return "rejected", "FencedIncarnation", none
        elif o.sequence <= state.sequence:
            if o.sequence == state.sequence and o.content == state.content:
                return "duplicate", "FencedDuplicateContent", none
            return "rejected", "FencedSequence", none
        if o.generation < state.generation:
            return "rejected", "FencedStaleGeneration", none
    if o.generation > state.generation + LEAP:
        return "rejected", "OutOfRange", none
    if o.high is not None and o.generation < o.high:
        return "rejected", "FencedStaleGeneration", none
    if state.incarnation is not None and o.generation == state.generation and o.epoch < state.epoch:
        return "rejected", "FencedStaleEpoch", none
    scope = frozenset() if o.scope is None else frozenset(o.scope)
    fences = []
    for subject, aspect, revision in zip(o.subjects, o.aspects, o.revisions):
        last = state.revisions.get((subject, aspect), 0)
        if known and aspect not in known:
            fences.append("Unsupported")
        elif scope and aspect not in scope:
            fences.append("FencedAuthority")
        elif revision and last and revision < last:
            fences.append("FencedRevision")
        else:
            fences.append("")
            state.revisions[subject, aspect] = max(last, revision)
    if fences and all(fences):
        return "fenced", fences[0], fences
    if o.incarnation != state.incarnation:
        state.seen = [*state.seen, o.incarnation]
        state.seen = state.seen if boots is None else state.seen[-boots:]
    state.incarnation, state.sequence, state.generation, state.epoch, state.content = o.incarnation, o.sequence, o.generation, o.epoch, o.content
    return "accepted", "Ok", fences


def nested(claims: DataFrame) -> DataFrame:
    """Observations of one claim each from flat claims; observations with claims stay as they are."""
    if "claims" in claims.columns:
        return claims
    rest = [c for c in claims.columns if c not in SAID]
    return claims.select(*rest, F.array(F.struct(*SAID)).alias("claims"))


def content(observations: DataFrame) -> Column:
    """SHA-256 of what an observation says, without its receive time: each part after its length, null apart from empty,
    claims in one order."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")))
    said = [c for c in ENVELOPE if c not in ("received_at", "arrival_seq")] + [c for c in ("schema", "fabric") if c in observations.columns]
    claims = F.array_sort(F.transform("claims", lambda c: F.concat(*[part(c[k]) for k in SAID])))
    return F.sha2(F.concat_ws(",", *[part(F.col(c)) for c in said], F.array_join(F.transform(claims, part), ";")), 256)


def checked(observations: DataFrame, schema: str | None = None, fabric: str | None = None, max_skew: int = 5 * SECOND) -> Column:
    """The code of the checks that need no order; Ok if all pass. schema, fabric: the only ones that are taken."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    keys = F.transform("claims", lambda c: F.struct(c["subject"], c["aspect"]))
    broken = empty(F.col("source")) | empty(F.col("incarnation")) | F.coalesce(F.col("sequence") < 1, F.lit(True)) | F.col("generation").isNull() | F.col("observed_at").isNull()
    code = F.when(broken, "InvalidArgument").when(F.size("claims") > CLAIMS, "TooLarge")
    if "schema" in observations.columns:
        code = code.when(empty(F.col("schema")), "InvalidArgument")
    code = code.when(F.exists("claims", lambda c: empty(c["subject"]) | empty(c["aspect"])) | (F.size(F.array_distinct(keys)) < F.size(keys)), "InvalidArgument")
    if schema is not None:
        code = code.when(F.col("schema") != schema, "Unsupported")
    if fabric is not None:
        code = code.when(~F.col("fabric").eqNullSafe(F.lit(fabric)), "FabricMismatch")
    return code.when(F.try_subtract("observed_at", "received_at") > max_skew, "ClockInconsistent").otherwise("Ok")


def prepared(observations: DataFrame, scopes: DataFrame | None) -> DataFrame:
    """What the fold needs of each observation; checked is the code of the checks, where they were made. scopes: source, aspects; null or empty where a source declared none."""
    each = lambda k: F.transform("claims", lambda c: c[k])
    revisions = F.transform("claims", lambda c: F.coalesce(c["revision"], F.lit(0)).cast("long"))
    frame = observations if "content" in observations.columns else observations.withColumn("content", content(observations))
    frame = frame if "high" in observations.columns else frame.withColumn("high", F.lit(None).cast("long"))
    frame = frame if "checked" in observations.columns else frame.withColumn("checked", F.lit("Ok"))
    frame = frame.select("source", "incarnation", *[F.col(c).cast("long").alias(c) for c in ENVELOPE[2:]], "content", each("subject").alias("subjects"), each("aspect").alias("aspects"), revisions.alias("revisions"), "checked", "high")
    if scopes is None:
        return frame.withColumn("scope", F.lit(None).cast("array<string>")).select(*FOLDED)
    declared = scopes.groupBy("source").agg(F.flatten(F.collect_list("aspects")).alias("scope"))
    return frame.join(declared, "source", "left").select(*FOLDED)


def admit(
    observations: DataFrame, scopes: DataFrame | None = None, schema: str | None = None, fabric: str | None = None, max_skew: int = 5 * SECOND, known_only: bool = False, registered: DataFrame | None = None, resumed: DataFrame | None = None, boots: int | None = SEEN
) -> DataFrame:
    """Outcome of every observation, in order of arrival per source: disposition, code, and the fence of each claim.

    scopes: source, aspects; claims of other aspects of a source that is in it are fenced. known_only: claims of aspects
    that aren't well known are fenced. registered: sources (source) that alone are taken. resumed: lineages of sources,
    which the fold goes on from; revisions aren't among what is remembered. boots: how many boots a source is remembered
    by, after which the oldest one counts as new again; None: all of them, so that no old boot ever comes back.

    Fences go by position: an observation's claims must come in one order whenever observations are read (sort what
    collect_list gathers), since evidence and fenced_claims read them once more.

    A source's order cannot be split, but its rows need not be held: rows are sorted within partitions by source and
    arrival, and the fold runs over Arrow batches with one source's lineage in memory at a time.
    """
    known = frozenset(a for a, _, _ in ASPECTS) if known_only else frozenset()
    frame = nested(observations)
    frame = frame.withColumn("claims", F.coalesce("claims", F.array().cast(frame.schema["claims"].dataType)))
    code = checked(frame, schema, fabric, max_skew)
    if registered is not None:
        frame = frame.join(registered.select("source").distinct().withColumn("_known", F.lit(True)), "source", "left")
        code = F.when(code != "Ok", code).when(F.col("_known").isNull(), "SourceUnknown").otherwise("Ok")
    frame = frame.withColumn("checked", code)
    ordered = prepared(frame.where("checked = 'Ok'"), scopes).select(*Observation._fields, "arrival_seq")
    if resumed is not None:
        ordered = ordered.unionByName(_remembered(resumed, ordered))
    # by a hash: an exchange by the source itself would be left out after a join by it, which Spark may split where skewed
    ordered = ordered.repartition(F.xxhash64("source")).sortWithinPartitions("source", F.asc_nulls_first("arrival_seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, state = None, Lineage()
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            # the claims of all rows at once, cut where each row's end
            ends = columns["subjects"].value_lengths().to_numpy().cumsum().tolist()
            flat = {c: columns[c].flatten().to_pylist() for c in ("subjects", "aspects", "revisions")}
            lists = [[flat[c][a:b] for a, b in zip([0, *ends], ends)] if c in flat else columns[c].to_pylist() for c in Observation._fields]
            out, arrived = [], columns["arrival_seq"].is_valid()
            for o, here in zip(map(Observation._make, zip(*lists)), arrived.to_pylist()):
                if o.source != source:
                    source, state = o.source, Lineage()
                if here:
                    out.append(step(state, o, known, boots))
                else:
                    state = Lineage(o.incarnation, o.sequence, o.generation, o.epoch, o.content, o.scope)
            disposition, code, fences = zip(*out) if out else ((), (), ())
            made = [columns["source"].filter(arrived), columns["arrival_seq"].filter(arrived), pa.array(disposition, pa.string()), pa.array(code, pa.string()), pa.array(fences, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(made, names=["source", "arrival_seq", "disposition", "code", "fences"])

    folded = ordered.mapInArrow(run, ADMITTED)
    refused = frame.where("checked <> 'Ok'").select("source", F.col("arrival_seq").cast("long").alias("arrival_seq"), F.lit("rejected").alias("disposition"), F.col("checked").alias("code"), F.transform("claims", lambda c: F.lit("")).alias("fences"))
    return folded.unionByName(refused)


def _remembered(resumed: DataFrame, ordered: DataFrame) -> DataFrame:
    """A row for each lineage that comes before its source's first arrival: without arrival_seq, the boots as scope."""
    had = {"content": F.coalesce("content", F.lit("")) if "content" in resumed.columns else F.lit(""), "scope": F.col("boots"), "high": F.lit(None), "arrival_seq": F.lit(None)}
    had |= {c: F.array() for c in ("subjects", "aspects", "revisions")}
    return resumed.select(*[had.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ordered.schema.fields])


def fold(observations: DataFrame, max_skew: int = 5 * SECOND, scopes: DataFrame | None = None, boots: int | None = SEEN) -> DataFrame:
    """source, arrival_seq, disposition, code of every observation."""
    return admit(observations, scopes, max_skew=max_skew, boots=boots).drop("fences")


def _before(rows: DataFrame, parts: int = 1024) -> DataFrame:
    """arrival_seq, high: the highest generation that was accepted before each arrival. The order of all arrivals is cut
    into parts; the parts' highest are few rows, so no task holds the order whole."""
    edge = rows.agg(F.min("arrival_seq").alias("low"), (F.max("arrival_seq") - F.min("arrival_seq") + 1).alias("span"))
    cut = rows.crossJoin(F.broadcast(edge)).withColumn("part", F.floor((F.col("arrival_seq") - F.col("low")) * parts / F.col("span")))
    taken = F.max(F.when(F.col("disposition") == "accepted", F.col("generation")))
    tops = cut.groupBy("part").agg(taken.alias("top"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("part", F.max("top").over(earlier).alias("earlier"))
    inside = Window.partitionBy("part").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    within = F.max(F.when(F.col("disposition") == "accepted", F.col("generation"))).over(inside)
    return cut.join(F.broadcast(tops), "part").select("arrival_seq", F.greatest(within, F.col("earlier")).alias("high"))


def admit_strictly(observations: DataFrame, rounds: int = 20, **options) -> DataFrame:
    """admit, where an observation below the highest generation that any source had accepted before is refused too.

    arrival_seq orders all arrivals. What is refused depends on what was accepted before, so the fold is repeated with
    the highs of the last outcome until these stay; the first arrivals that differ move on with each round, so where they
    stay doesn't depend on where they begin. They begin as if all arrivals were accepted, which is mostly right, so that
    one fold is enough.
    """
    frame = nested(observations)
    named = frame.select("source", "arrival_seq", "generation")
    highs = _before(named.withColumn("disposition", F.lit("accepted"))).persist()
    for _ in range(rounds):
        outcome = admit(frame.join(highs, "arrival_seq", "left"), **options).persist()
        now = _before(named.join(outcome.select("source", "arrival_seq", "disposition"), ["source", "arrival_seq"])).persist()
        settled = now.join(highs.withColumnRenamed("high", "was"), "arrival_seq").where("not (high <=> was)").isEmpty()
        highs.unpersist()
        if settled:
            now.unpersist()
            return outcome
        highs = now
    raise RuntimeError("strict admission needs more rounds")


def canonical(observations: DataFrame) -> DataFrame:
    """Observations with their claims in order of subject and aspect, and their causal references, if any, in order of
    antecedent, strength and basis."""
    by = lambda *names: lambda a, b: F.coalesce(*[F.when(a[n] < b[n], -1).when(a[n] > b[n], 1) for n in names], F.lit(0))
    made = observations.withColumn("claims", F.array_sort("claims", by("subject", "aspect")))
    return made.withColumn("causal", F.array_sort("causal", by("antecedent", "strength", "basis"))) if "causal" in made.columns else made


def _outcome_of(observations: DataFrame, outcomes: DataFrame) -> DataFrame:
    frame = nested(observations)
    frame = frame.withColumn("observation_id", content(frame))
    return frame.join(outcomes, ["source", "arrival_seq"])


def evidence(observations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The claims of accepted observations, one a row, with fenced, fence and observation_id. A fenced claim stays as
    evidence of what was said but asserts nothing."""
    rows = _outcome_of(observations, outcomes).where("disposition = 'accepted'")
    rest = [c for c in rows.columns if c not in ("claims", "fences", "disposition", "code")]
    each = rows.select(*rest, F.explode(F.arrays_zip("claims", F.col("fences").alias("fence"))).alias("z"))
    return each.select(*rest, *[F.col(f"z.claims.{k}").alias(k) for k in SAID], (F.col("z.fence") != "").alias("fenced"), F.nullif(F.col("z.fence"), F.lit("")).alias("fence"))


def _last(frame: DataFrame, most: int | None) -> DataFrame:
    return frame if most is None else frame.orderBy(F.desc("arrival_seq")).limit(most)


def rejections(observations: DataFrame, outcomes: DataFrame, most: int | None = RETAINED) -> DataFrame:
    """Observations that were refused or lost all claims: the first refusal of each content, unless it had been accepted
    before; the last ones."""
    rows = _outcome_of(observations, outcomes)
    by = Window.partitionBy("observation_id").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.col("disposition").isin("accepted", "rejected", "fenced").cast("int")).over(by), F.lit(0))
    first = rows.withColumn("known", known).where("disposition in ('rejected', 'fenced') and known = 0")
    return _last(first.select("observation_id", "source", "incarnation", "sequence", "generation", "epoch", "received_at", "arrival_seq", F.col("code").alias("fence")), most)


def fenced_claims(observations: DataFrame, outcomes: DataFrame, most: int | None = RETAINED) -> DataFrame:
    """Claims that a fence took: the first of each content, subject and aspect; the last ones."""
    rows = _outcome_of(observations, outcomes).where("disposition in ('accepted', 'fenced')")
    rest = ["observation_id", "source", "incarnation", "sequence", "received_at", "arrival_seq"]
    each = rows.select(*rest, F.explode(F.arrays_zip("claims", F.col("fences").alias("fence"))).alias("z")).where("z.fence <> ''")
    named = each.select(*rest, F.col("z.claims.subject").alias("subject"), F.col("z.claims.aspect").alias("aspect"), F.col("z.fence").alias("fence"))
    first = F.row_number().over(Window.partitionBy("observation_id", "subject", "aspect").orderBy("arrival_seq"))
    return _last(named.withColumn("n", first).where("n = 1").drop("n"), most)


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: observations by disposition, and fenced claims."""
    by = [F.count_if(F.col("disposition") == d).alias(d) for d in ("accepted", "duplicate", "fenced", "rejected")]
    return outcomes.agg(*by, F.coalesce(F.sum(F.size(F.filter("fences", lambda f: f != ""))), F.lit(0)).alias("claims_fenced"))


def evicted(records: DataFrame, bound: int) -> DataFrame:
    """Evidence within its bound: beyond it the oldest by receive time go, a sixteenth of the bound at least."""
    n = records.count()
    if n <= bound:
        return records
    drop = max(n - bound, min(n, bound // 16))
    ties = [c for c in ("source", "sequence", "observation_id", "subject", "aspect") if c in records.columns]
    return records.orderBy(F.desc("received_at"), *[F.desc(c) for c in ties]).limit(n - drop)


def register(declarations: DataFrame) -> DataFrame:
    """All declarations (source, name, authority, aspects, declared_seq) with status, and current: the last one of a
    source that is in order, which replaces those before."""
    aspects = F.coalesce("aspects", F.array().cast("array<string>"))
    status = F.when(F.coalesce("source", F.lit("")) == "", "InvalidArgument").when(F.octet_length("name") > NAME_BYTES, "TooLarge").when(F.size(aspects) > SCOPE, "TooLarge").when(F.size(F.array_distinct(aspects)) < F.size(aspects), "InvalidArgument").otherwise("Ok")
    judged = declarations.withColumn("aspects", F.array_sort(aspects)).withColumn("status", status)
    last = F.max(F.when(F.col("status") == "Ok", F.col("declared_seq"))).over(Window.partitionBy("source"))
    return judged.withColumn("current", F.coalesce((F.col("status") == "Ok") & (F.col("declared_seq") == last), F.lit(False)))


def authorities(registry: DataFrame) -> DataFrame:
    """source, authority (its number) of current declarations."""
    number = F.array_position(F.array(*map(F.lit, AUTHORITY)), F.col("authority")).cast("int") - 1
    return registry.where("current").select("source", number.alias("authority"))


def recovered(claims: DataFrame, epoch: int) -> DataFrame:
    """Evidence after a restart: marked as recovered at the restart epoch, so that none of it is fresh by itself."""
    return claims.drop("recovered", "recovery_epoch").withColumn("recovered", F.lit(True)).withColumn("recovery_epoch", F.lit(epoch).cast("long"))


def lineages(records: DataFrame) -> DataFrame:
    """What sources are remembered by after a restart, from their records alone: the last incarnation in order of name,
    the SEEN last of them, the highest sequence and generation, the highest epoch of that generation, first and last
    times, number of records; with observation_id, content is that of the last record, so that its repetition is known."""
    one = "observation_id" in records.columns
    last = [F.max_by("observation_id", F.struct("sequence", "received_at")).alias("content")] if one else []
    top = F.max(F.struct("generation", "epoch"))
    boots = F.sort_array(F.collect_set("incarnation"))
    by = records.groupBy("source").agg(
        F.max("incarnation").alias("incarnation"), boots.alias("boots"), F.max("sequence").alias("sequence"), top.getField("generation").alias("generation"), top.getField("epoch").alias("epoch"),
        F.min("received_at").alias("first_receive"), F.max("received_at").alias("last_receive"), F.max("observed_at").alias("last_observation"), (F.count_distinct("observation_id") if one else F.count("*")).alias("records"), *last,
    )
    return by.withColumn("boots", F.slice("boots", F.greatest(F.size("boots") - SEEN + 1, F.lit(1)), SEEN))
