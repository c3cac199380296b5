"""Running a bounded stream to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from duolex.session import scratch_path


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, output: str | None = None, mode: str = "append") -> None:
    """Process everything available now, then stop. The checkpoint is in the shared folder."""
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", scratch_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
    )
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(output)
    query.awaitTermination()
