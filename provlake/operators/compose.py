"""From claims to truth: supersession, freshness, retention, the truth ladder, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.functions.expressions import freshness, named
from provlake.model import AUTHORITY, CLAIMS_PER_ASPECT, FRESHNESS, KINDS, TRUTH, Policy

#: Fixed value: the least number of partitions of claims at several times.
PARTS = 96


def _by_source(claims: DataFrame) -> DataFrame:
    """What both functions below need of each source; where they are joined, its exchange is made once."""
    time = [F.max("observed_at").alias("observed_max"), F.max("received_at").alias("received_max"), F.min("received_at").alias("received_min")]
    current = F.max_by("incarnation", F.struct("received_at", "incarnation")).alias("current")
    return claims.groupBy("source").agg(F.max(F.struct("generation", "epoch")).alias("top"), *time, current)


def high_water(claims: DataFrame) -> DataFrame:
    """One row: highest generation, highest epoch within it, and the watermarks of time. One aggregation: the largest
    (generation, epoch) has both."""
    top = F.max("top")
    return _by_source(claims).agg(
        top.getField("generation").alias("high"), top.getField("epoch").alias("high_epoch"),
        F.max("observed_max").alias("observed_max"), F.max("received_max").alias("received_max"), F.min("received_min").alias("received_min"),
    )


def current_incarnation(claims: DataFrame) -> DataFrame:
    """The incarnation of each source that was received last, ties to the larger id."""
    return _by_source(claims).select("source", "current")


def _ties(claims: DataFrame) -> list[Column]:
    """A last order among claims of one source and sequence: by content, never by arrival at a task."""
    if "observation_id" in claims.columns:
        return [F.desc("observation_id")]
    return [F.desc(c) for c in ("generation", "epoch", "observed_at", "received_at", "revision", "value", "supported") if c in claims.columns]


def claim_records(claims: DataFrame, policy: Policy, evaluated: Column | None = None, authority: DataFrame | None = None, times: list[Column] | None = None) -> DataFrame:
    """Claims with supersession flags, freshness, authority, current and assertive.

    The high water is one row, so it is broadcast; incarnations and authorities have a row for each source and are
    joined as Spark sees fit. evaluated: by default the last receive time. times: several such times; each claim is then
    there once for each, with its number as at, from one pass of the window.
    """
    frame = claims.crossJoin(F.broadcast(high_water(claims))).join(current_incarnation(claims), "source")
    reported = F.lit(AUTHORITY.index("reported"))
    if authority is None:
        frame = frame.withColumn("authority", reported)
    else:
        frame = frame.join(authority.select("source", "authority"), "source", "left").withColumn("authority", F.coalesce("authority", reported))
    latest = Window.partitionBy("subject", "aspect", "source", "incarnation").orderBy(F.desc("sequence"), *_ties(claims))
    fenced = F.col("fenced") if "fenced" in claims.columns else F.lit(False)
    old_epoch = (F.col("generation") == F.col("high")) & (F.col("epoch") < F.col("high_epoch"))
    if times:  # rows are there for each time and sorted in the task where they are multiplied, so tasks are smaller
        parts = max(PARTS, int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        frame = frame.repartition(parts, "subject", "aspect", "source", "incarnation")
    frame = frame.select(
        *claims.columns, "authority", (F.col("generation") < F.col("high")).alias("old_generation"), old_epoch.alias("old_epoch"),
        (F.col("incarnation") != F.col("current")).alias("old_incarnation"), (F.row_number().over(latest) > 1).alias("old_sequence"),
        F.array(*(times or [F.col("received_max") if evaluated is None else evaluated])).alias("_times"),
    )
    frame = frame.withColumn("is_current", ~(F.col("old_generation") | F.col("old_epoch") | F.col("old_incarnation") | F.col("old_sequence") | fenced))
    frame = frame.select("*", F.posexplode("_times").alias("at", "_time")) if times else frame.withColumn("_time", F.col("_times")[0])
    verdict = freshness(F.col("_time"), F.col("observed_at"), F.col("received_at"), F.col("recovered"), policy.fresh, policy.aging, policy.recovered_may_be_fresh)
    frame = frame.withColumn("freshness", verdict).drop("_times", "_time")
    return frame.withColumn("assertive", F.col("supported") & F.col("is_current") & (F.col("freshness") == 0))


def _key(records: DataFrame) -> list[str]:
    return ["subject", "aspect"] + ["at"] * ("at" in records.columns)


def retained(records: DataFrame, most: int = CLAIMS_PER_ASPECT) -> DataFrame:
    """The claims of each aspect that are kept: current ones first, fresher, later, then in canonical order. The rank
    limit is pushed below the exchange, so no key is gathered whole."""
    rank = Window.partitionBy(*_key(records)).orderBy(F.desc("is_current"), "freshness", F.desc("sequence"), "source", "incarnation", *_ties(records))
    return records.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)


def aspect_states(records: DataFrame, policy: Policy) -> DataFrame:
    """subject, aspect, truth, agreed value, coverage, and signature, the set of (source, freshness) as text. One
    aggregation by key over retained claims; at most 32 rows meet, so sets are small."""
    held = F.col("assertive")
    need = policy.table(records.sparkSession)
    different = lambda c: F.size(F.collect_set(F.when(held, F.col(c)))).cast("long")
    grouped = records.groupBy(*_key(records)).agg(
        F.count("*").alias("claims"), F.bool_or("supported").alias("any_supported"), F.count_if(held).alias("assertions"),
        F.count_if(~F.col("supported")).alias("unsupported"), F.count_if(F.col("is_current") & F.col("supported")).alias("current"),
        different("value").alias("values"), different("source").alias("fresh_sources"), F.max(F.when(held, F.col("authority"))).alias("best"),
        F.max(F.when(held, F.col("value"))).alias("agreed"), F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "source", "freshness"))), ",").alias("signature"),
    )
    sources, authority = policy.default_coverage
    joined = grouped.join(F.broadcast(need), "aspect", "left").fillna({"need_sources": sources, "need_authority": authority})
    few = (F.col("fresh_sources") < F.col("need_sources")) | (F.col("best") < F.col("need_authority"))
    truth = F.when(~F.col("any_supported"), 1).when(F.col("assertions") == 0, 3).when(F.col("values") > 1, 2).when(few, 4).otherwise(5)
    joined = joined.withColumn("truth_code", truth)
    covered = F.col("truth_code").isin(2, 4, 5)
    return joined.select(
        *_key(records), "truth_code", named(TRUTH, F.col("truth_code")).alias("truth"), F.when(F.col("truth_code") == 5, F.col("agreed")).alias("agreed"),
        F.when(covered, F.col("fresh_sources")).otherwise(0).alias("fresh_sources"), F.when(covered, named(AUTHORITY, F.col("best"))).otherwise("none").alias("best_authority"),
        "need_sources", named(AUTHORITY, F.col("need_authority")).alias("need_authority"), "claims", "unsupported", "current", "values", "signature",
    )


def parents(aspects: DataFrame) -> DataFrame:
    """node, kind, parent of every subject; the parent is the agreed value of topology.parent where that is known."""
    agreed = F.max(F.when((F.col("aspect") == "topology.parent") & (F.col("truth") == "known"), F.col("agreed"))).alias("parent")
    return aspects.groupBy(F.col("subject").alias("node")).agg(agreed).select("node", F.substring_index("node", "/", 1).alias("kind"), "parent")


def conflict_groups(records: DataFrame) -> DataFrame:
    """The different asserted values of conflicting aspects with their sources."""
    groups = records.where("assertive").groupBy("subject", "aspect", "value").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n_sources"))
    several = groups.groupBy("subject", "aspect").agg(F.count("*").alias("n_values")).where("n_values > 1")
    return groups.join(several, ["subject", "aspect"])


def subject_states(aspects: DataFrame) -> DataFrame:
    """Worst truth, number of aspects and topology truth of each subject."""
    return aspects.groupBy("subject").agg(F.min("truth_code").alias("code"), F.count("*").alias("aspects"), F.coalesce(F.max(F.when(F.col("aspect") == "topology.parent", F.col("truth_code"))), F.lit(0)).alias("topology")).select("subject", named(TRUTH, F.col("code")).alias("worst_truth"), "aspects", named(TRUTH, F.col("topology")).alias("topology_truth"))


def source_summary(claims: DataFrame, policy: Policy, evaluated: Column, registry: DataFrame | None = None) -> DataFrame:
    """Per source: retained records, last sequence and times, boots, current incarnation, freshness. registry: sources
    (source) that are listed even if they are silent."""
    by = claims.groupBy("source").agg(
        F.count("*").alias("records"), F.max("sequence").alias("last_sequence"), F.max("observed_at").alias("last_observation"), F.max("received_at").alias("last_receive"),
        F.count_distinct("incarnation").alias("boots"), F.max_by("incarnation", F.struct("received_at", "incarnation")).alias("current"),
    )
    if registry is not None:
        by = registry.select("source").distinct().join(by, "source", "full").fillna(0, ["records", "boots"])
    verdict = named(FRESHNESS, freshness(evaluated, F.col("last_observation"), F.col("last_receive"), F.lit(False), policy.fresh, policy.aging))
    return by.withColumn("freshness", F.when(F.col("last_receive").isNull(), "stale").otherwise(verdict))


def stats_by_kind(aspects: DataFrame) -> DataFrame:
    """kind, subjects: of every kind, also those without subjects."""
    kinds = aspects.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    by = aspects.select("subject").distinct().groupBy(F.substring_index("subject", "/", 1).alias("kind")).agg(F.count("*").alias("subjects"))
    return kinds.join(by, "kind", "left").fillna(0, ["subjects"])


def stats(aspects: DataFrame) -> DataFrame:
    return aspects.groupBy("truth").agg(F.count("*").alias("aspects"))
