"""Reasons for truth states, with the evidence and the fences behind them. Texts are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlake.functions.expressions import escaped, format_utc, named
from provlake.model import AUTHORITY, FRESHNESS, TRUTH

#: Most lines of each kind in an explanation.
LINES = 128
#: Fixed texts: what a claim's flags say.
FLAGS = (
    ("not supported", " [declared unsupported]"), ("old_generation", " [superseded by a later generation]"), ("old_epoch", " [superseded by a later epoch of the same generation]"),
    ("old_incarnation", " [superseded by a later incarnation of the same source]"), ("old_sequence", " [superseded by a later sequence from the same source incarnation]"),
)
#: Fixed texts: what each strength of a causal reference says, in order of strength.
CAUSAL = (
    ("correlates-with", "recorded correlation only; no causal relationship is asserted"),
    ("temporally-precedes", "recorded temporal ordering only; no causal relationship is asserted"),
    ("contributory-evidence", "recorded contributing evidence only; no causal relationship is asserted"),
)


def reasons(aspects: DataFrame, conflicts: DataFrame) -> DataFrame:
    """subject, aspect, reason: one sentence for each aspect. Fixed texts."""
    said = conflicts.groupBy("subject", "aspect").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("; \""), "value", F.lit("\" from "), "n_sources", F.lit(" fresh source(s)")))), "").alias("groups"))
    a = aspects.join(said, ["subject", "aspect"], "left")
    name = F.concat(F.lit("'"), "aspect", F.lit("'"))
    text = (
        F.when(F.col("truth") == "unsupported", F.concat(F.lit("unsupported: "), "unsupported", F.lit(" of "), "claims", F.lit(" retained claim(s) for aspect "), name, F.lit(" declare that the reporting source cannot supply it")))
        .when(F.col("truth") == "conflicting", F.concat(F.lit("conflicting: "), "values", F.lit(" distinct values are asserted by fresh evidence for aspect "), name, F.lit(" and this runtime does not choose between them"), "groups"))
        .when(F.col("truth") == "stale", F.concat(F.lit("stale: "), "current", F.lit(" current claim(s) for aspect "), name, F.lit(" exist but none is fresh at the snapshot evaluation time")))
        .when(F.col("truth") == "incomplete", F.concat(F.lit("incomplete: fresh evidence for aspect "), name, F.lit(" agrees but coverage is "), "fresh_sources", F.lit("/"), "need_sources", F.lit(" distinct fresh source(s) with best authority "), "best_authority", F.lit(" (requires "), "need_authority", F.lit(")")))
        .when(F.col("truth") == "known", F.concat(F.lit("known: "), "fresh_sources", F.lit(" fresh source(s) agree on aspect "), name, F.lit(" with value \""), "agreed", F.lit("\"")))
        .otherwise(F.concat(F.lit("unknown: no evidence for aspect "), name, F.lit(" has been accepted; absence of evidence is not positive evidence")))
    )
    return a.select("subject", "aspect", text.alias("reason"))


#: Fixed texts: marks of a claim in a summary.
MARKS = (
    ("not supported", " unsupported"), ("old_generation", " superseded-generation"), ("old_epoch", " superseded-epoch"),
    ("old_incarnation", " superseded-incarnation"), ("old_sequence", " superseded-sequence"), ("recovered", " recovered"),
)


def summary(aspects: DataFrame, retained: DataFrame, conflicts: DataFrame) -> DataFrame:
    """subject, aspect, place, key, line: a line for each subject (place 0, no aspect), aspect (1), conflict (2) and
    claim (3). Fixed texts."""
    shown = lambda c: escaped(F.coalesce(c, F.lit("")))
    worst = aspects.groupBy("subject").agg(named(TRUTH, F.min("truth_code")).alias("w"))
    row = lambda frame, aspect, place, key, *said: frame.select("subject", aspect.alias("aspect"), F.lit(place).alias("place"), key.alias("key"), F.concat(*said).alias("line"))
    value = F.when(F.col("agreed").isNotNull(), F.concat(F.lit(" value="), shown(F.col("agreed")))).otherwise("")
    name, none = F.col("aspect"), F.lit("")
    rows = row(worst, none, 0, none, F.lit("  subject "), F.col("subject"), F.lit(" worst="), F.col("w"))
    rows = rows.unionByName(row(aspects, name, 1, none, F.lit("    aspect "), name, F.lit(" "), F.col("truth"), value, F.lit(" fresh_sources="), F.col("fresh_sources"), F.lit("/"), F.col("need_sources"), F.lit(" authority="), F.col("best_authority"), F.lit("/"), F.col("need_authority")))
    rows = rows.unionByName(row(conflicts, name, 2, F.col("value"), F.lit("      conflict "), shown(F.col("value")), F.lit(" sources="), F.col("n_sources")))
    marks = [F.when(F.expr(c), text).otherwise("") for c, text in MARKS]
    key = F.concat_ws(" ", "source", "incarnation", F.lpad(F.col("sequence").cast("string"), 20, "0"))
    return rows.unionByName(row(retained, name, 3, key, F.lit("      claim "), F.col("source"), F.lit(" seq="), F.col("sequence"), F.lit(" "), named(FRESHNESS, F.col("freshness")), F.lit(" value="), shown(F.col("value")), *marks))


def evidence_lines(records: DataFrame) -> DataFrame:
    """subject, aspect, line: one for each retained claim."""
    flags = [F.when(F.expr(c), text).otherwise("") for c, text in FLAGS] + [F.when(F.col("recovered"), " [recovered from persistence]").otherwise("")]
    said = [
        F.col("aspect"), F.lit(": source "), F.col("source"), F.lit(" incarnation "), F.substring("incarnation", 1, 16), F.lit(" sequence "), F.col("sequence"),
        F.lit(" authority "), named(AUTHORITY, F.col("authority")), F.lit(" freshness "), named(FRESHNESS, F.col("freshness")),
        F.lit(" observed "), format_utc(F.col("observed_at")), F.lit(" received "), format_utc(F.col("received_at")), F.lit(' value "'), F.coalesce("value", F.lit("")), F.lit('"'), *flags,
    ]
    return records.select("subject", "aspect", "source", "incarnation", "sequence", F.concat(*said).alias("line"))


def subject(aspects: DataFrame, retained: DataFrame, name: str, aspect: str | None = None, rejected: DataFrame | None = None, fenced: DataFrame | None = None, most: int = LINES) -> DataFrame:
    """kind (truth, reason, evidence, fence), n, line: why a subject, or one aspect of it, is in its state.

    truth is the worst of the selected aspects. Rejections have no subject: those of sources with evidence on the
    selected aspects are listed. A subject or aspect without evidence is unknown. Each kind has most lines at most.
    """
    mine = F.col("subject") == name
    mine = mine & (F.col("aspect") == aspect) if aspect else mine
    some, claims = aspects.where(mine), retained.where(mine)
    groups = claims.where("assertive").groupBy("subject", "aspect", "value").agg(F.count_distinct("source").alias("n_sources"))
    said = reasons(some, groups.join(groups.groupBy("subject", "aspect").agg(F.count("*").alias("n")).where("n > 1"), ["subject", "aspect"]))
    rows = said.select(F.lit("reason").alias("kind"), F.col("aspect").alias("o1"), F.lit("").alias("o2"), F.lit(0).cast("long").alias("o3"), F.concat("aspect", F.lit(": "), "reason").alias("line"))
    rows = rows.unionByName(evidence_lines(claims).select(F.lit("evidence").alias("kind"), F.col("aspect").alias("o1"), F.concat_ws(" ", "source", "incarnation").alias("o2"), F.col("sequence").alias("o3"), "line"))
    if rejected is not None:
        text = F.concat(F.lit("rejected observation "), F.substring("observation_id", 1, 12), F.lit(" from source "), "source", F.lit(" sequence "), "sequence", F.lit(": "), "fence")
        rows = rows.unionByName(rejected.join(claims.select("source").distinct(), "source", "left_semi").select(F.lit("fence").alias("kind"), F.lit("0").alias("o1"), F.col("source").alias("o2"), F.col("sequence").alias("o3"), text.alias("line")))
    if fenced is not None:
        text = F.concat(F.lit("fenced claim for "), "subject", F.lit(" "), "aspect", F.lit(" from source "), "source", F.lit(" sequence "), "sequence", F.lit(": "), "fence")
        rows = rows.unionByName(fenced.where(mine).select(F.lit("fence").alias("kind"), F.lit("1").alias("o1"), F.col("source").alias("o2"), F.col("sequence").alias("o3"), text.alias("line")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("o1", "o2", "o3", "line"))).where(F.col("n") <= most).select("kind", "n", "line")
    worst = some.agg(F.min("truth_code").alias("code"))
    truth = worst.select(F.lit("truth").alias("kind"), F.lit(1).alias("n"), F.coalesce(named(TRUTH, F.col("code")), F.lit("unknown")).alias("line"))
    nothing = f"unknown: no evidence has been accepted for the requested aspect of subject '{name}'" if aspect else f"unknown: subject '{name}' has no accepted evidence in this snapshot; absence of evidence is not positive evidence"
    absent = worst.where("code is null").select(F.lit("reason").alias("kind"), F.lit(1).alias("n"), F.lit(nothing).alias("line"))
    return truth.unionByName(absent).unionByName(rows)


def causality(observations: DataFrame) -> DataFrame:
    """observation_id, antecedent, strength, basis, known (the antecedent is among the observations), line: one for each
    causal reference of observations (observation_id, causal: antecedent, strength, basis). Unknown strengths count as
    the weakest, and no reference asserts a cause."""
    each = observations.select("observation_id", F.explode("causal").alias("c")).select("observation_id", "c.antecedent", "c.strength", F.coalesce("c.basis", F.lit("")).alias("basis"))
    each = each.withColumn("strength", F.when(F.col("strength").isin(*[n for n, _ in CAUSAL]), F.col("strength")).otherwise(CAUSAL[0][0]))
    said = F.coalesce(*[F.when(F.col("strength") == n, text) for n, text in CAUSAL])
    basis = F.when(F.col("basis") != "", F.concat(F.lit(" (basis: "), "basis", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("observation "), F.substring("observation_id", 1, 12), F.lit(" "), "strength", F.lit(" observation "), F.substring("antecedent", 1, 12), basis, F.lit("; "), said)
    there = observations.select(F.col("observation_id").alias("antecedent"), F.lit(True).alias("known")).distinct()
    return each.withColumn("line", line).join(there, "antecedent", "left").select("observation_id", "antecedent", "strength", "basis", F.coalesce("known", F.lit(False)).alias("known"), "line")
