"""Incremental ingestion: a stream's micro-batches become idempotent upserts of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.workspace import Workspace


def upsert_stream(workspace: Workspace, stream: DataFrame, *, dataset: str, name: str, checkpoint: str, order: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Upserts ``stream(member_key, value[, order])`` into ``dataset``.  Of rows that share a
    key in a micro-batch the one of highest ``order`` counts.  A micro-batch that is run
    again has the same batch name, so it changes nothing a second time."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.groupBy("member_key").agg(F.max_by("value", order).alias("value")) if order else rows.select("member_key", "value")
        if rows.isEmpty():
            return
        base = workspace.current(dataset)
        label = f"{name}-{number}"
        if base is None:
            workspace.select_current(dataset, workspace.create(rows, label), None)
        elif workspace.inspect(base)["note"].get("batch") != label:
            workspace.upsert(base, rows, label, dataset=dataset)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
