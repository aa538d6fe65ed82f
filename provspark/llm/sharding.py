"""Sharding by weighted rendezvous hashing of a stable record key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a shard's rows are numbered in, apart from each other.
BLOCKS = 4096


def _hash52(key: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..n-1 whose -ln(u) / weight is least, u drawn from the MD5 of key and shard; ties: the lower shard.

    A shard's share of keys is in proportion to its weight. Adding a shard moves keys into it only, removing the
    last one moves its keys only. A weight of 0 gives a shard nothing.
    """
    drawn = [F.struct((-F.log((_hash52(key, str(s)) + 0.5) / float(1 << 52)) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (F.array_min(F.array(*drawn)) if len(drawn) > 1 else drawn[0])["shard"]


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row a document.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32: of those bytes. Shard and grown_shard (by
    ``grown``, one more shard of weight 1 unless given) follow from doc_id and the shards alone; null ids share
    a key. slot numbers a shard's rows from 0 without gaps by block, doc_id, crc32 and size, whatever the input's
    order or partitions; equal rows take any order among themselves. A block follows from the hash of id and
    crc32, and equal rows are counted before they are numbered, so neither a large shard nor a hot id or text is one
    task. Extra columns are ignored.
    """
    grown = tuple(weights) + (1.0,) if grown is None else grown
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    block = (_hash52(F.concat(key, F.lit(":"), F.col("text_crc32").cast("string")), "block") % BLOCKS).cast("int")
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_times"))
    equal = equal.select("*", shard_of(key, weights).alias("shard"), shard_of(key, grown).alias("grown_shard"), block.alias("_block"))
    sizes = equal.groupBy("shard", "_block").agg(F.sum("_times").alias("_n"))
    before = sizes.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = equal.withColumn("_row", F.coalesce(F.sum("_times").over(order), F.lit(0))).join(F.broadcast(before), ["shard", "_block"])  # at most BLOCKS rows a shard
    first = F.col("_before") + F.col("_row")
    each = numbered.withColumn("slot", F.explode(F.sequence(first, first + F.col("_times") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 8, files: int = 1) -> None:
    """Write ``docs`` as Parquet folders shard=0, shard=1, ..., each shard in ``files`` files at least."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    parts = len(weights) * files
    spread = docs.withColumn("shard", shard_of(key, weights)).repartition(parts, "shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(files)))
    spread.write.partitionBy("shard").parquet(path)
