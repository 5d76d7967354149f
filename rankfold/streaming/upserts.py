"""Operation logs as streams: each micro-batch is merged into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.store import Store


def stream_into(ops: DataFrame, store: Store, checkpoint: str):
    """Start a query that applies ops (key, value, seq, deleted) batch by batch; `.store` of the handle is the latest.

    seq, not arrival, decides which write wins, so late rows are harmless.
    """
    held = {"store": store}

    def apply(batch: DataFrame, _: int) -> None:
        held["store"] = held["store"].apply(batch)

    query = ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, held
