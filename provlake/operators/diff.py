"""What changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.functions.digests import digest_of
from provlake.model import CHANGES_PER_DIFF


def aspect_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Aspects (subject, aspect, truth, agreed, signature) of after that differ, of subjects that both have; an aspect
    that before lacks counts as unknown, and one that after lacks is not reported."""
    both = before.select("subject").distinct()
    old = before.select("subject", "aspect", F.col("truth").alias("truth_before"), F.col("agreed").alias("agreed_before"), F.col("signature").alias("signature_before"))
    joined = after.join(both, "subject", "left_semi").join(old, ["subject", "aspect"], "left").fillna({"truth_before": "unknown"})
    differs = (F.col("truth") != F.col("truth_before")) | ~F.col("agreed").eqNullSafe(F.col("agreed_before")) | ~F.col("signature").eqNullSafe(F.col("signature_before"))
    return joined.where(differs).select("subject", "aspect", "truth_before", "truth", "agreed_before", "agreed")


def refresh_changes(aspects: DataFrame) -> DataFrame:
    """aspect_changes of the same claims at two times (at 0 and 1), from one aggregation: both have all subjects."""
    pick = lambda c, at, name: F.max(F.when(F.col("at") == at, F.col(c))).alias(name)
    both = [pick(c, at, f"{c}_{at}") for c in ("truth", "agreed", "signature") for at in (0, 1)]
    joined = aspects.groupBy("subject", "aspect").agg(*both)
    differs = ~F.col("truth_0").eqNullSafe(F.col("truth_1")) | ~F.col("agreed_0").eqNullSafe(F.col("agreed_1")) | ~F.col("signature_0").eqNullSafe(F.col("signature_1"))
    return joined.where(differs).select("subject", "aspect", F.coalesce("truth_0", F.lit("unknown")).alias("truth_before"), F.col("truth_1").alias("truth"), F.col("agreed_0").alias("agreed_before"), F.col("agreed_1").alias("agreed"))


def subjects_added(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.select("subject").distinct().join(before.select("subject").distinct(), "subject", "left_anti")


def source_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources that came, went, or have another incarnation or freshness."""
    old = before.select("source", F.col("current").alias("was"), F.col("freshness").alias("freshness_was"))
    joined = after.select("source", "current", "freshness").join(old, "source", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("current").isNull(), "removed").when((F.col("was") != F.col("current")) | (F.col("freshness_was") != F.col("freshness")), "changed")
    return joined.withColumn("change", change).where("change is not null").select("source", "change", "was", "current", "freshness_was", "freshness")


def sources_changed(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """changes with sources_added and sources_removed, by the signatures of both sides."""
    names = lambda c: F.array_distinct(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.regexp_replace(p, ":[^:]*$", "")))
    side = lambda frame, name: frame.select("subject", "aspect", F.col("signature").alias(name))
    joined = changes.join(side(before, "_b"), ["subject", "aspect"], "left").join(side(after, "_a"), ["subject", "aspect"], "left")
    minus = lambda one, two: F.array_join(F.array_sort(F.array_except(names(F.col(one)), F.concat(names(F.col(two)), F.array(F.lit(""))))), ",")
    return joined.select(*changes.columns, minus("_a", "_b").alias("sources_added"), minus("_b", "_a").alias("sources_removed"))


def header(before: DataFrame, after: DataFrame, changes: DataFrame, added: DataFrame, removed: DataFrame, most: int = CHANGES_PER_DIFF) -> DataFrame:
    """One row: generations and epochs of both sides (headers of snapshots), whether they changed, numbers of subjects
    added and removed and of changes within the bound, truncated."""
    pick = lambda frame, end: frame.select(F.col("generation").alias(f"generation_{end}"), F.col("epoch").alias(f"epoch_{end}"))
    n = lambda frame, name: frame.agg(F.count("*").alias(name))
    row = pick(before, "before").crossJoin(pick(after, "after")).crossJoin(n(added, "subjects_added")).crossJoin(n(removed, "subjects_removed")).crossJoin(n(changes, "n"))
    return row.select("*", (F.col("generation_before") != F.col("generation_after")).alias("generation_changed"), (F.col("epoch_before") != F.col("epoch_after")).alias("epoch_changed"), F.least("n", F.lit(most)).alias("changes"), (F.col("n") > most).alias("truncated")).drop("n")


def restarts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: restart_observed, restarts_between (0 where the count falls) of two headers of snapshots."""
    pick = lambda frame, end: frame.select(F.col("restart_epoch").alias(f"e_{end}"), F.col("restart_count").alias(f"n_{end}"))
    return pick(before, "b").crossJoin(pick(after, "a")).select((F.col("e_b") != F.col("e_a")).alias("restart_observed"), F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0)).alias("restarts_between"))


def digest(changes: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """digest: one row, SHA-256 of the changes and of the subjects that came and went, whatever their order."""
    text = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("~")) for k in c])
    rows = changes.select(F.lit("change").alias("part"), F.col("subject").alias("key"), text("aspect", "truth_before", "truth", "agreed_before", "agreed").alias("line"))
    for part, frame in (("added", added), ("removed", removed)):
        rows = rows.unionByName(frame.select(F.lit(part).alias("part"), F.col("subject").alias("key"), F.lit("").alias("line")))
    return digest_of(rows)


def first(changes: DataFrame, most: int = CHANGES_PER_DIFF) -> DataFrame:
    """The changes within the bound, by subject and aspect; header tells whether there are more."""
    return changes.orderBy("subject", "aspect").limit(most)
