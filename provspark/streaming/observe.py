"""Incremental observation, held activities and idempotent publication as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provspark.operators.registry import publish

STATES = "object_uuid string, ord long, content string, state_no long"


def observe_stream(rows: DataFrame) -> DataFrame:
    """States that a stream of ``(object_uuid, ord, content)`` opens, as the batch ``observe`` does.

    The state kept for an object is its latest content and number, whatever the stream's length. ``ord`` is the
    only clock: an object's rows are ordered inside a micro-batch, and a row older than what is known is refused.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ord, last, number = state.get if state.exists else (None, None, 0)
        opened = []
        seen = [pair for part in parts for pair in zip(part["ord"].tolist(), part["content"].tolist())]
        for at, content in sorted(seen, key=lambda pair: pair[0]):
            content = None if pd.isna(content) else content
            if last_ord is not None and at <= last_ord:
                raise ValueError(f"object {key[0]}: observation {at} comes after {last_ord}")
            if number == 0 or content is None or content != last:
                number += 1
                opened.append((key[0], int(at), content, number))
            last_ord, last = int(at), content
        state.update((last_ord, last, number))
        if opened:
            yield pd.DataFrame(opened, columns=["object_uuid", "ord", "content", "state_no"])

    return rows.groupBy("object_uuid").applyInPandasWithState(run, STATES, "last_ord long, last string, number long", "append", GroupStateTimeout.NoTimeout)


def release_stream(pending: DataFrame, remap: DataFrame, key: str, event_time: str, wait: str = "1 hour") -> DataFrame:
    """Activities held until their temporary output id gets a final one: a stream-stream join bounded by ``wait``.

    ``pending(key, event_time, ...)`` and ``remap(temporary, final, remapped_at)``; what is not named in time drops.
    """
    held = pending.withWatermark(event_time, wait)
    named = remap.withWatermark("remapped_at", wait)
    near = (F.col("remapped_at") >= F.col(event_time)) & (F.col("remapped_at") <= F.col(event_time) + F.expr(f"interval {wait}"))
    return held.join(named, (F.col(key) == F.col("temporary")) & near)


def publish_batches(path: str, key: str = "fingerprint") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends to the Parquet table at ``path`` what is not there by ``key``.

    Each batch goes to a folder of its own number, so a batch that is run again replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        folders = [f"{path}/batch={i}" for i in range(number)]
        there = [f for f in folders if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f))]
        known = spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)
        publish(batch, known, key).where("created").drop("created").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
