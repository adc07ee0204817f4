"""Admission as a stream: the step of the batch fold with a source's lineage as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provlake.operators.ingest import OUTCOME, Lineage, checked, nested, prepared, step

STATE = "incarnation string, sequence long, generation long, epoch long, content string, seen array<string>, subjects array<string>, aspects array<string>, revisions array<long>"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lineage = Lineage()
    if state.exists:
        *head, seen, subjects, aspects, revisions = state.get
        lineage = Lineage(*head, list(seen), dict(zip(zip(subjects, aspects), revisions)))
    rows = pd.concat(list(batches)).sort_values("arrival_seq")
    rows["high"] = None
    out = []
    for o in rows.itertuples(index=False):
        refused = o.checked != "Ok"
        out.append((o.source, o.arrival_seq, *(("rejected", o.checked) if refused else step(lineage, o)[:2])))
    state.update((lineage.incarnation, lineage.sequence, lineage.generation, lineage.epoch, lineage.content, lineage.seen, [s for s, _ in lineage.revisions], [a for _, a in lineage.revisions], [int(r) for r in lineage.revisions.values()]))
    yield pd.DataFrame(out, columns=["source", "arrival_seq", "disposition", "code"])


def admit(observations: DataFrame, scopes: DataFrame | None = None, schema: str | None = None, fabric: str | None = None) -> DataFrame:
    """Outcomes of a stream of observations; rows of one micro-batch are taken in order of arrival. scopes: a static
    table as in the batch fold. A source's rows of one micro-batch are held together: bound them by the trigger (such as
    maxFilesPerTrigger)."""
    frame = nested(observations)
    made = prepared(frame.withColumn("checked", checked(frame, schema, fabric)), scopes)
    return made.groupBy("source").applyInPandasWithState(_advance, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)
