"""Published snapshots as tables below a folder: entries, and the aspects of each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.operators import compose, diff
from provlake.plans.snapshots import Snapshot

#: Snapshots that stay; older ones are no longer found.
CAPACITY = 256
ENTRY = "index long, snapshot_id string, published_at long, generation long, epoch long, evaluated long, aspects long, subjects long"


class NotFound(LookupError):
    """No snapshot of that name or index is there, or it was evicted."""


class History:
    """The last snapshots that were published, in order of an index from 1."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), max(1, capacity)

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}").select(*[f.split()[0] for f in schema.split(", ")])
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def newest(self, most: int | None = None) -> DataFrame:
        """The entries that are retained, the last ones first."""
        rows = self.entries().orderBy(F.desc("index"))
        return rows if most is None else rows.limit(most)

    def entries(self) -> DataFrame:
        """The entries that are retained; order by index."""
        every = self._table("entries", ENTRY)
        return every.crossJoin(F.broadcast(every.agg(F.max("index").alias("_last")))).where(F.col("index") > F.col("_last") - self.capacity).drop("_last")

    def publish(self, snapshot: Snapshot, published_at: int) -> int:
        """Write the snapshot's aspects, then its entry, which makes it visible; returns its index. A snapshot that is the
        last one again isn't written."""
        last = self._table("entries", ENTRY).agg(F.max("index"), F.max_by("snapshot_id", "index")).first()
        made = snapshot.digest().first()[0]
        if made == last[1]:
            return last[0]
        index = (last[0] or 0) + 1
        snapshot.aspects.write.mode("overwrite").parquet(f"{self.path}/aspects/index={index}")
        sums = self.aspects(index).agg(F.count("*").alias("aspects"), F.count_distinct("subject").alias("subjects"))
        row = self.spark.createDataFrame([(made,)], "snapshot_id string").crossJoin(snapshot.header().select("generation", "epoch", "evaluated")).crossJoin(sums)
        row = row.select(F.lit(index).cast("long").alias("index"), "*", F.lit(published_at).cast("long").alias("published_at"))
        row.select(*[f.split()[0] for f in ENTRY.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.path}/entries")
        return index

    def aspects(self, index: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/aspects/index={index}")

    def latest(self) -> int:
        last = self.entries().agg(F.max("index")).first()[0]
        if last is None:
            raise NotFound("no snapshot has been published")
        return last

    def at(self, index: int) -> DataFrame:
        if self.entries().where(F.col("index") == index).isEmpty():
            raise NotFound(f"snapshot {index} was not published here or has been evicted")
        return self.aspects(index)

    def find(self, snapshot_id: str) -> DataFrame:
        found = self.entries().where(F.col("snapshot_id") == snapshot_id).agg(F.max("index")).first()[0]
        if found is None:
            raise NotFound(f"{snapshot_id} is not in the history")
        return self.aspects(found)

    def diff(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Changes of aspects between two of them."""
        return diff.aspect_changes(before, after)

    def diff_latest(self, lookback: int = 1) -> DataFrame:
        last = self.latest()
        if last <= lookback:
            raise NotFound(f"{last} snapshot(s) were published, {lookback} step(s) back is not available")
        return self.diff(self.at(last - lookback), self.at(last))


def worst_by_subject(history: History, index: int) -> DataFrame:
    """Subjects of a published snapshot with their worst truth."""
    return compose.subject_states(history.at(index))
