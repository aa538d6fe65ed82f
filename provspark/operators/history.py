"""States over time: latest, numbered, observed, broken, cut to the last few."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at(order: Sequence[str], reverse: bool = False) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def latest(rows: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``. An aggregate with map-side combine: a key with many rows costs one a task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def latest_states(states: DataFrame) -> DataFrame:
    """The state of the highest sequence of each object; its position stands in for a missing sequence and breaks ties."""
    at = states.withColumn("_seq", F.coalesce("sequence", "pos"))
    return latest(at, "object_uuid", ["_seq", "pos"]).drop("_seq")


def next_sequence(states: DataFrame) -> DataFrame:
    """One row: the sequence the next state gets; 0 for no states."""
    return states.agg((F.coalesce(F.max(F.coalesce("sequence", "pos")), F.lit(-1)) + 1).cast("long").alias("next_sequence"))


def observe(rows: DataFrame, key: str, order: Sequence[str], content: Sequence[str], fresh: Column | None = None, known: Column | None = None) -> DataFrame:
    """Rows that open a new state: ``rows`` with ``state_no`` counting from 1 for each key.

    A row continues the state before it when all of ``content`` is null-safe equal to the latest one; A, B, A
    gives three states. ``known`` false (no fingerprint) or ``fresh`` true always opens a state.
    """
    seen = Window.partitionBy(key).orderBy(*_at(order))
    content = list(content)
    changed = F.row_number().over(seen) == 1
    for c in content:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(seen))
    if known is not None:
        changed = changed | ~known
    if fresh is not None:
        changed = changed | fresh
    opened = rows.withColumn("_new", changed).where("_new").drop("_new")
    return opened.withColumn("state_no", F.row_number().over(seen).cast("long"))


def last_of_each(rows: DataFrame, key: str, order: Sequence[str], most: int, flag: str) -> DataFrame:
    """The last ``most`` rows of each key, with ``rank`` 1 for the newest and whether rows are left out as ``flag``."""
    newest = Window.partitionBy(key).orderBy(*_at(order, reverse=True))
    ranked = rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most)
    sizes = rows.groupBy(key).agg((F.count("*") > most).alias(flag))
    return ranked.join(sizes, key)


def first_of_each(rows: DataFrame, key: str, order: Sequence[str], most: int, count: str, flag: str) -> DataFrame:
    """The first ``most`` rows of each key with ``position`` from 0, the true ``count``, and whether rows are left out."""
    oldest = Window.partitionBy(key).orderBy(*_at(order))
    ranked = rows.withColumn("position", (F.row_number().over(oldest) - 1).cast("long")).where(F.col("position") < most)
    sizes = rows.groupBy(key).agg(F.count("*").alias(count)).withColumn(flag, F.col(count) > most)
    return ranked.join(sizes, key)


def last_break(rows: DataFrame, key: str, order: str, marked: Column) -> DataFrame:
    """``(key, broken_at)``: where each key's last marked row stands; keys without one are left out."""
    return rows.where(marked).groupBy(key).agg(F.max(order).alias("broken_at"))


def since_break(rows: DataFrame, breaks: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that belong to the key's present identity: at or after its last break."""
    return rows.join(breaks, key, "left").where(F.col("broken_at").isNull() | (F.col(order) >= F.col("broken_at"))).drop("broken_at")


def holder(rows: DataFrame, breaks: DataFrame, key: str, order: str, live: DataFrame) -> DataFrame:
    """``rows`` with ``holder``: the live object of the key, null if it is gone or the row is from before the break."""
    known = live.select(key).distinct().withColumn("_live", F.lit(True))
    joined = rows.join(breaks, key, "left").join(known, key, "left")
    held = F.col("_live") & (F.col("broken_at").isNull() | (F.col(order) >= F.col("broken_at")))
    return joined.withColumn("holder", F.when(held, F.col(key))).drop("broken_at", "_live")


def grouped(rows: DataFrame, key: str, order: Sequence[str], items: Sequence[str], out: str) -> DataFrame:
    """Each key's items as a list in record order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, *[c for c in items if c not in order])))
    only = (lambda x: x[items[0]]) if len(items) == 1 else (lambda x: F.struct(*[x[c].alias(c) for c in items]))
    return rows.groupBy(key).agg(F.transform(listed, only).alias(out))


def unique_names(rows: DataFrame, base: str, order: Sequence[str], out: str) -> DataFrame:
    """Names made unique as base, 2-base, 3-base, ...; a numbered name that some row has by itself is passed over.

    The k-th repeat of a base takes the k-th number from 2 that no row's own name takes.
    """
    place = Window.partitionBy(base).orderBy(*_at(order))
    placed = rows.withColumn("_k", F.row_number().over(place))
    own = rows.select(F.col(base).alias("_taken")).distinct()
    parts = own.withColumn("_n", F.regexp_extract("_taken", r"^([1-9][0-9]{0,8})-.", 1)).where("_n <> ''")
    held = parts.select(F.col("_n").cast("long").alias("_n"), F.regexp_replace("_taken", r"^[1-9][0-9]*-", "").alias(base)).where("_n >= 2")
    skips = held.groupBy(base).agg(F.sort_array(F.collect_set("_n")).alias("_skips"))
    numbered = placed.join(skips, base, "left")
    free = F.aggregate(F.coalesce("_skips", F.array().cast("array<bigint>")), F.col("_k").cast("long"), lambda at, s: F.when(s <= at, at + 1).otherwise(at))
    return numbered.withColumn(out, F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat(free.cast("string"), F.lit("-"), base))).drop("_k", "_skips")
