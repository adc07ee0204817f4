"""Observations and a containment forest from star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_704_067_200_000_000_000
DAY = 86_400 * 1_000_000_000


def observations(events: DataFrame) -> DataFrame:
    """One observation with one claim for each event."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    base = events.withColumn("ns", ns)
    device = F.col("event_id") % 40
    aspect = {"click": "link.state", "view": "operational.health", "error": "failure.state", "purchase": "reachability.state", "signup": "congestion.level"}
    return base.select(
        F.concat(F.lit("source/s"), F.col("user_id") % 6).alias("source"), F.expr(f"concat('boot-', ns div {10 * DAY})").alias("incarnation"), (F.col("event_id") + 1).alias("sequence"), (F.col("event_id") + 1).alias("arrival_seq"),
        F.expr(f"1 + (ns - {START}) div {15 * DAY}").alias("generation"), F.expr(f"1 + ((ns - {START}) div {5 * DAY}) % 3").alias("epoch"),
        F.concat(F.lit("device/d"), device).alias("subject"), F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in aspect.items()]).alias("aspect"),
        F.when(F.col("value") < 8, "low").when(F.col("value") < 20, "mid").otherwise("high").alias("value"), (~((device % 8 == 7) & (F.col("event_type") == "signup"))).alias("supported"),
        (F.col("event_id") % 23 == 0).alias("recovered"), F.col("ns").alias("observed_at"), (F.col("ns") + (F.col("event_id") % 5) * 1_000_000_000).alias("received_at"), F.lit(0).cast("long").alias("revision"), F.col("event_id"),
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark.read.parquet(f"{sf_dir}/events.parquet"))


def batched(claims: DataFrame) -> DataFrame:
    """Observations with several claims: a source's events of each thirty, the envelope from the last one. Every fortieth
    of them is of another schema, another fabric, or from the future; where an aspect of a device is claimed twice, the
    observation is out of order too. Claims come in order of their events: what is gathered has no order of its own, and
    fences, which go by position, are joined with claims that are gathered once more."""
    every = F.expr("event_id div 30").alias("n")
    last = lambda c: F.max_by(c, "event_id").alias(c)
    said = ("subject", "aspect", "value", "supported", "revision")
    claimed = F.transform(F.sort_array(F.collect_list(F.struct("event_id", *said))), lambda c: F.struct(*[c[k].alias(k) for k in said]))
    grouped = claims.groupBy("source", every).agg(*[last(c) for c in ("incarnation", "generation", "epoch", "recovered", "observed_at", "received_at")], F.max("arrival_seq").alias("arrival_seq"), claimed.alias("claims"))
    turn = F.col("n") % 40
    return grouped.select(
        "source", "incarnation", (F.col("n") + 1).alias("sequence"), "arrival_seq", "generation", "epoch", "recovered", F.when(turn == 11, F.col("received_at") + 10_000_000_000).otherwise(F.col("observed_at")).alias("observed_at"), "received_at",
        F.when(turn == 9, "observation/9").otherwise("observation/1").alias("schema"), F.when(turn == 7, "fabric/other").otherwise("fabric/one").alias("fabric"), "claims",
    )


def declarations(spark: SparkSession) -> DataFrame:
    """What sources declare: scopes, authorities, replacements, and declarations that are out of order."""
    rows = [
        ("source/s0", "zero", "reported", [], 1), ("source/s0", "zero", "authoritative", [], 2), ("source/s1", "one", "corroborated", None, 3), ("source/s2", "x" * 129, "authoritative", [], 4),
        ("source/s3", "three", "authoritative", ["link.state", "link.state"], 5), ("source/s5", "five", "reported", ["link.state", "failure.state"], 6), ("", "none", "reported", [], 7), ("source/s7", "silent", "inferred", [], 8),
    ]
    return spark.createDataFrame(rows, "source string, name string, authority string, aspects array<string>, declared_seq long")


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, kind, parent: regions, nations, customers, orders, and the ports that line items name, each once."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    up = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.lpad(F.col(key).cast("string"), 10, "0"))
    node = lambda frame, kind, key, parent: frame.select(up(kind, key).alias("node"), F.lit(kind).alias("kind"), parent.alias("parent"))
    out = node(read("region"), "site", "r_regionkey", F.lit(None).cast("string"))
    for part in (node(read("nation"), "pod", "n_nationkey", up("site", "n_regionkey")), node(read("customer"), "rack", "c_custkey", up("pod", "c_nationkey")), node(read("orders"), "device", "o_orderkey", up("rack", "o_custkey"))):
        out = out.unionByName(part)
    pairs = read("lineitem").select("l_orderkey", "l_linenumber").distinct()
    return out.unionByName(pairs.select(F.concat(up("port", "l_orderkey"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("node"), F.lit("port").alias("kind"), up("device", "l_orderkey").alias("parent")))
