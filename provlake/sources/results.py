"""Results as nested rows and as lines of JSON: 64-bit numbers as strings, members in a fixed order, nulls kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructType

from provlake.functions.expressions import format_utc, named, number_of
from provlake.model import AUTHORITY, FRESHNESS, TRUTH


def _texts(column: Column, kind: DataType) -> Column:
    """The column with its 64-bit numbers as strings, at any depth."""
    if isinstance(kind, LongType):
        return column.cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda e: _texts(e, kind.elementType))
    if isinstance(kind, StructType):
        made = F.struct(*[_texts(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), made)
    return column


def as_json(rows: DataFrame) -> DataFrame:
    """value: the JSON object of each row, its members in order of the columns."""
    members = [_texts(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*members), {"ignoreNullFields": "false"}).alias("value"))


def _listed(rows: DataFrame, body: list[Column], name: str) -> DataFrame:
    """subject, aspect and the rows of each as a sorted array; at most the retained claims of an aspect meet."""
    return rows.groupBy("subject", "aspect").agg(F.array_sort(F.collect_list(F.struct(*body))).alias(name))


def subjects(aspects: DataFrame, claims: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """One row for each subject: subject, kind, topology_truth, worst_truth and its aspects in order of name, each with
    its coverage and, where they are given, conflicts (of compose.conflict_groups) and claims (of compose.retained)."""
    number = lambda c: number_of(AUTHORITY, F.col(c))
    enough = (F.col("fresh_sources") >= F.col("need_sources")) & (number("best_authority") >= number("need_authority"))
    coverage = F.struct(F.col("fresh_sources").alias("distinct_fresh_sources"), F.col("need_sources").cast("long").alias("required_distinct_fresh_sources"), F.col("best_authority").alias("best_fresh_authority"), F.col("need_authority").alias("required_authority"), enough.alias("satisfied"))
    rows, body = aspects, ["aspect", F.substring_index("aspect", ".", 1).alias("domain"), "truth", F.col("agreed").alias("agreed_value"), coverage.alias("coverage")]
    key = ["subject", "aspect"]
    if conflicts is not None:
        group = [F.col("value"), F.split("sources", ",").alias("sources"), F.col("n_sources").alias("fresh_sources")]
        rows = rows.join(_listed(conflicts, group, "conflicts"), key, "left")
        body.append(F.coalesce("conflicts", F.array()).alias("conflicts"))
    if claims is not None:
        flags = [F.col(f"old_{c}").alias(f"superseded_{c}") for c in ("generation", "epoch", "incarnation", "sequence")]
        claim = [F.col("source"), F.col("incarnation"), named(AUTHORITY, F.col("authority")).alias("authority"), F.col("sequence"), F.col("value"), F.col("supported"), named(FRESHNESS, F.col("freshness")).alias("freshness")]
        claim += [F.col("observed_at"), format_utc(F.col("observed_at")).alias("observed_at_utc"), F.col("received_at"), format_utc(F.col("received_at")).alias("received_at_utc"), F.col("recovered"), *flags]
        rows = rows.drop("claims").join(_listed(claims, claim, "claims"), key, "left")
        body.append(F.coalesce("claims", F.array()).alias("claims"))
    topology = F.coalesce(F.max(F.when(F.col("aspect") == "topology.parent", F.col("truth_code"))), F.lit(0))
    made = rows.groupBy("subject").agg(named(TRUTH, topology).alias("topology_truth"), named(TRUTH, F.min("truth_code")).alias("worst_truth"), F.array_sort(F.collect_list(F.struct(*body))).alias("aspects"))
    return made.select("subject", F.substring_index("subject", "/", 1).alias("kind"), "topology_truth", "worst_truth", "aspects")
