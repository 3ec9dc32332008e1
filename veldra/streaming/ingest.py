"""Index maintenance from a stream: every micro-batch becomes one delta of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import VectorEngine


def append_stream(engine: VectorEngine, name: str, stream: DataFrame, checkpoint: str, compact_every: int = 0, **trigger) -> StreamingQuery:
    """Insert the rows of a streaming DataFrame into an index; ``compact_every`` rebuilds after so many batches.

    A batch that is run again after a failure first removes the keys it is about to insert, so it counts once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        engine.update(name, batch)
        if compact_every and (number + 1) % compact_every == 0:
            engine.compact(name)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
