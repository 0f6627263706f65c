"""Alignment of a stream of requests through the same content-addressed cache: each micro-batch aligns only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tables import written
from ..operators.alignment import Encoder, Routing, align, request_keys
from ..sources.caches import through_cache


def align_stream(requests: DataFrame, cache: str, checkpoint: str, encoder: Callable[[str], Encoder] | None = None, routing: Routing = Routing(), once: bool = True) -> StreamingQuery:
    """Start a query that aligns streamed requests (lang, src, tgt) into the Parquet cache.

    A batch that runs again after a failure finds its keys in the cache, so nothing is aligned twice into it."""

    def keyed(missing: DataFrame) -> DataFrame:
        numbered = written(missing.withColumn("id", F.monotonically_increasing_id()), "missing")
        return align(numbered, encoder, routing).join(numbered.select("id", "k"), "id").drop("id")

    def each(batch: DataFrame, _: int) -> None:
        through_cache(request_keys(batch, routing), cache, keyed)

    writer = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
