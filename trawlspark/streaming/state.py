"""The toggle log as a stream: each micro-batch is merged into the placed table, slice by slice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.placed import merge


def replay_stream(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the last toggle of each (user_id, passage_id) of a streamed log in the table ``name`` (``placed.create``); all that is
    there now is read, then it ends. A batch that is repeated after a failure merges the same toggles, which changes nothing.
    """

    def one(batch: DataFrame, _: int) -> None:
        merge(batch.sparkSession, name, batch)

    return log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
