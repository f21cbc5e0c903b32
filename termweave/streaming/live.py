"""Mapping of terms that arrive as a stream: each micro-batch goes through the same plan as a sheet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.mapping import Options, map_terms


def map_stream(terms: DataFrame, index: DataFrame, vector_col: str, encode: Callable, path: str, checkpoint: str, o: Options | None = None, available_now: bool = True) -> StreamingQuery:
    """Streams terms (sourceName, ...) into Parquet at path, a folder for each batch: a batch that is run again replaces its own."""
    options = o or Options()

    def write(batch: DataFrame, number: int) -> None:
        got = map_terms(batch.sparkSession, batch, index, vector_col, options, encode)
        best = got.candidates.join(got.queries.select("query_id", "source_name", "source_code"), "query_id")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = terms.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
