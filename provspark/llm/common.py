"""Pieces shared by the operators: scratch tables, word splitting, ordered offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provspark.scratch import drop_path, materialize, scratch_path, shared_dir

__all__ = ["WORD", "bounded_batches", "drop_path", "each_text", "materialize", "running_start", "scratch_path", "shared_dir", "text_bytes", "whole_texts", "words_of"]

#: A word is a run of anything but space, tab, LF, VT, FF and CR (Java regex).
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of an Arrow string column, None for null, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def each_text(column: pa.Array, step: int = 512) -> Iterator[bytes | None]:
    """``text_bytes`` of a long column, a few texts in memory at a time."""
    for at in range(0, len(column), step):
        yield from text_bytes(column.slice(at, step))


def bounded_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Have whole texts go to Python workers ``rows`` at a time where the session has Spark's own 10,000: buffers on both sides hold one batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def whole_texts(column: pa.Array) -> pa.Array:
    """A string column, or a slice of one, as an array of its own (null: empty) with offsets from 0: some Arrow functions misread others."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    return pa.concat_arrays([texts, pa.array([], pa.large_string())])


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased (bytes.lower and bytes.split touch ASCII only)."""
    return raw.lower().split() if raw else []


def running_start(df: DataFrame, order: str, ties: list[str], amount: str, out: str, per_range: int = 100_000) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows before this one, by ``order`` (nulls first) then ``ties``.

    Rows are dealt out in ranges of order and ties, so many that one has about ``per_range`` rows however large the
    table, null and equal ids spread by their ties; a range is summed apart. The ranges' totals, a row each, are
    summed in a second, small step and joined back. Rows equal in order and ties take any order among themselves.
    """
    key = [F.col(order).asc_nulls_first(), *(F.col(t).asc_nulls_first() for t in ties)]
    ranges = max(1, -(-df.count() // per_range))
    ranged = materialize(df.repartitionByRange(ranges, *key).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    own = Window.partitionBy("_range").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inner", F.coalesce(F.sum(amount).over(own), F.lit(0)))
        .join(F.broadcast(before), "_range")  # a row for each ``per_range`` documents
        .withColumn(out, (F.col("_inner") + F.col("_before")).cast("long"))
        .drop("_inner", "_before", "_range")
    )
