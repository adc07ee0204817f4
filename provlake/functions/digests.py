"""Digests of tables, whatever the order of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def headed(digest: DataFrame, head: DataFrame | None) -> DataFrame:
    """digest with the generation and epoch of a snapshot's header, if one is given."""
    if head is None:
        return digest
    return digest.crossJoin(F.broadcast(head.select("generation", "epoch"))).select(F.sha2(F.concat_ws("|", "generation", "epoch", "digest"), 256).alias("digest"))


def digest_of(content: DataFrame) -> DataFrame:
    """digest: one row, SHA-256 of rows (part, key, line), whatever their order.

    The lines of a key are hashed together, keys by a four-digit prefix of their own hash, and at last the 65,536
    prefixes; so what comes together is a key's lines, one prefix, or rows of a fixed number. A prefix follows from its
    key, so both steps are made where the rows are dealt by prefix, once.
    """
    dealt = content.withColumn("prefix", F.substring(F.sha2("key", 256), 1, 4)).repartition("prefix")
    keys = dealt.groupBy("prefix", "part", "key").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("d"))
    prefixes = keys.groupBy("prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "part", "key", "d"))), "\n"), 256).alias("d"))
    return prefixes.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "prefix", "d"))), "\n"), 256).alias("digest"))
