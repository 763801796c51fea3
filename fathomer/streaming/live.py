"""Live mode: a clock stream lists the sources; additions, edits and deletions trigger an update, an unchanged listing doesn't."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..storage import read_text, write_text


def poll(spark: SparkSession, roots: str | list[str], update: Callable[..., object], state: str) -> bool:
    """Call update(sources, ...), one table per root, if any listing differs from the last one that was updated for; whether it did.

    The digest of the listings is kept in the folder ``state`` after the update, so one that fails is tried again.
    """
    roots = [roots] if isinstance(roots, str) else roots
    listed = [files.items(spark, r) for r in roots]
    now = files.digest(files.combined(*[files.signature(x) for x in listed]))
    if now == read_text(spark, f"{state}/_LISTING"):
        return False
    update(*listed)
    write_text(spark, f"{state}/_LISTING", now)
    return True


def watch(spark: SparkSession, roots: str | list[str], update: Callable[..., object], state: str, interval: str = "2 seconds") -> StreamingQuery:
    """Poll at every tick of a stream until it is stopped."""
    busy = threading.Lock()

    def tick(df: DataFrame, _: int) -> None:
        with busy:
            poll(spark, roots, update, state)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", f"{state}/clock").trigger(processingTime=interval).start()
