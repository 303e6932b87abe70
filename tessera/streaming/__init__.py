"""Search for queries that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.search import LshIndex, centred
from tessera.sources.polygons import polygons_of_lines


def search_stream(lines: DataFrame, index: LshIndex, path: str, k: int = 10) -> DataStreamWriter:
    """A writer that answers each micro-batch of polygon lines (``value``) from a fixed index and appends the lists as Parquet.

    The caller sets the checkpoint location and the trigger, and starts it.
    """

    def answer(batch: DataFrame, number: int) -> None:
        polygons, _ = polygons_of_lines(batch)
        # a batch that is run again replaces its own folder
        index.knn(centred(polygons), k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(answer)
