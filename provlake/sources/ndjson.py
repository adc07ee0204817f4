"""Observations as lines of JSON: reader with a status per line, writer, and what admission takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions.expressions import ENVELOPE, canon_json, envelope, members

LINE = (
    "schema string, fabric string, source string, incarnation string, sequence string, generation string, epoch string, observed_at string, "
    f"claims array<struct<subject:string,aspect:string,value:{ENVELOPE},supported:boolean,revision:string>>, "
    "causal array<struct<antecedent:string,strength:string,basis:string>>, metadata array<struct<k:string,v:string>>"
)
NEEDED = ("schema", "fabric", "source", "incarnation", "sequence", "generation", "observed_at")
MOST_BYTES = 1 << 20
#: Kinds of values.
VALUES = ("null", "bool", "int", "uint", "real", "text", "blob", "list", "map")
#: Bounds of metadata: entries, bytes of a key, bytes of a value.
ENTRIES, KEY, TEXT = 32, 64, 256


def _metadata(entries: Column) -> Column:
    """The code of metadata; null if it is in order."""
    keys = F.transform(entries, lambda e: e["k"])
    odd = F.exists(entries, lambda e: ~F.coalesce(e["k"], F.lit("")).rlike("^[a-z0-9._-]+$") | e["v"].isNull())
    large = (F.size(entries) > ENTRIES) | F.exists(entries, lambda e: (F.octet_length(e["k"]) > KEY) | (F.octet_length(e["v"]) > TEXT))
    return F.when(large, "TooLarge").when(odd | (F.size(F.array_distinct(keys)) < F.size(keys)), "InvalidArgument")


def _parsed(lines: DataFrame) -> DataFrame:
    row = lines.select("value", F.from_json("value", LINE).alias("o"))
    missing = F.lit(False)
    for name in NEEDED:
        missing |= F.col(f"o.{name}").isNull()
    number = lambda c: F.col(f"o.{c}").try_cast("long")
    unread = number("sequence").isNull() | number("generation").isNull() | number("observed_at").isNull()
    status = F.when(F.octet_length("value") > MOST_BYTES, "TooLarge").when(F.col("o").isNull() | missing, "MalformedInput").when(unread, "MalformedInput")
    status = status.when(F.exists("o.claims", lambda c: ~F.coalesce(c["value"]["k"], F.lit("")).isin(*VALUES)), "Unsupported").when(F.exists("canonical", lambda c: c.isNull()), "MalformedInput")
    status = F.coalesce(status.when(number("sequence") < 1, "InvalidArgument"), _metadata(F.col("o.metadata")), F.lit("Ok"))
    row = row.withColumn("canonical", F.transform("o.claims", lambda c: canon_json(c["value"]["k"], c["value"]["v"])))
    claim = lambda c, k: F.struct(c["subject"].alias("subject"), c["aspect"].alias("aspect"), c["value"].alias("value"), F.get("canonical", k).alias("canonical"), F.coalesce(c["supported"], F.lit(True)).alias("supported"), F.coalesce(c["revision"].try_cast("long"), F.lit(0)).alias("revision"))
    metadata = F.when(F.col("status") == "Ok", F.map_from_entries("o.metadata"))
    return row.withColumn("status", status).select(
        "status", *[F.col(f"o.{c}") for c in ("schema", "fabric", "source", "incarnation")], number("sequence").alias("sequence"), number("generation").alias("generation"),
        F.coalesce(number("epoch"), F.lit(0)).cast("long").alias("epoch"), number("observed_at").alias("observed_at"), F.coalesce(F.transform("o.claims", claim), F.array()).alias("claims"),
        F.col("o.causal").alias("causal"), metadata.alias("metadata"),
    )


def read(spark: SparkSession, path: str, fail: bool = False) -> DataFrame:
    """One row for each line that is not blank or a # comment (after blanks): status and the members; 64-bit numbers are
    decimal strings, epoch and revision default to 0, supported to true. fail: the first bad line ends the query."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(~F.ltrim("value").startswith("#"))
    made = _parsed(lines)
    if not fail:
        return made
    bad = F.raise_error(F.concat(F.lit("a line of observations is refused: "), "status", F.lit(", source "), F.coalesce("source", F.lit("unknown")), F.lit(", sequence "), F.coalesce(F.col("sequence").cast("string"), F.lit("unknown"))))
    return made.withColumn("status", F.when(F.col("status") == "Ok", F.col("status")).otherwise(bad))


def read_one(spark: SparkSession, path: str) -> DataFrame:
    """As read, of files that hold one observation each, over any number of lines."""
    return _parsed(spark.read.text(path, wholetext=True))


def arrivals(read: DataFrame, received_at: Column) -> DataFrame:
    """What admission takes of the rows that were read well: values as canonical text, received_at as given, arrivals in
    order of the lines of a file and of the files."""
    claim = lambda c: F.struct(c["subject"].alias("subject"), c["aspect"].alias("aspect"), c["canonical"].alias("value"), c["supported"].alias("supported"), c["revision"].cast("long").alias("revision"))
    numbered = read.withColumn("arrival_seq", F.monotonically_increasing_id())
    return numbered.where("status = 'Ok'").select("schema", "fabric", "source", "incarnation", "sequence", "generation", "epoch", "observed_at", received_at.cast("long").alias("received_at"), "arrival_seq", F.lit(False).alias("recovered"), F.transform("claims", claim).alias("claims"))


def lines(observations: DataFrame) -> DataFrame:
    """value: the JSON line of each observation that was read, as it may be read again: 64-bit numbers as strings, values
    of every kind in their envelopes."""
    named = lambda c, *names: members(*[c[n].alias(n) for n in names])
    claim = lambda c: F.concat(F.lit("{"), F.concat_ws(",", named(c, "subject", "aspect"), F.concat(F.lit('"value":'), envelope(c["value"]["k"], c["value"]["v"])), named(c, "supported"), members(c["revision"].cast("string").alias("revision"))), F.lit("}"))
    special = {
        "claims": F.concat(F.lit('"claims":['), F.array_join(F.transform("claims", claim), ","), F.lit("]")),
        "metadata": members(F.transform(F.map_entries("metadata"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))).alias("metadata")),
    }
    of = lambda c: special[c] if c in special else members(F.col(c).cast("string").alias(c) if c in ("sequence", "generation", "epoch", "observed_at") else F.col(c))
    return observations.select(F.concat(F.lit("{"), F.concat_ws(",", *[of(c) for c in observations.columns if c != "status"]), F.lit("}")).alias("value"))
