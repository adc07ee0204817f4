"""A view that follows a stream: each micro-batch is appended to the evidence and a snapshot is published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from provlake.model import Policy
from provlake.plans.history import History
from provlake.plans.snapshots import Snapshot


def publisher(evidence: str, history: str, policy: Policy) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch over claims of accepted observations. A batch has a folder of its own below evidence,
    which a second run of the same batch overwrites, so no claim counts twice."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{evidence}/batch={number}")
        claims = spark.read.parquet(evidence).drop("batch")
        if not claims.isEmpty():
            History(spark, history).publish(Snapshot(claims, policy), number)

    return run
