"""Semantic diff of two snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tall(df: DataFrame, group: str, key: str, fields: Sequence[str]) -> DataFrame:
    """A snapshot as rows ``(grp, id, ord, field, value)``, values as text, fields in declared order."""
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)])
    return df.select(F.lit(group).alias("grp"), F.col(key).cast("string").alias("id"), F.explode(cells).alias("c")).select("grp", "id", "c.*")


def changes(old: DataFrame, new: DataFrame, group: str, key: str, fields: Sequence[str], only: str | None = None) -> DataFrame:
    """``(grp, change, id, ord, field, old, new)``: items added, removed, and fields changed.

    Items are matched by key in one full outer join of the wide rows; only changed cells are unfolded. ``only``
    keeps one kind of change. Keys are unique in each snapshot; null keys match nothing.
    """
    side = lambda df, p: df.select(F.col(key).alias("_k"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(p))
    pairs = side(old, "a").join(side(new, "b"), "_k", "full_outer")
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(f"a.{f}").alias("old"), F.col(f"b.{f}").alias("new")) for i, f in enumerate(fields)])
    whole = F.array(F.struct(F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    changed = F.filter(cells, lambda c: ~c["old"].eqNullSafe(c["new"]))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    found = pairs.select(F.lit(group).alias("grp"), kind.alias("change"), F.col("_k").cast("string").alias("id"), F.explode(F.when(kind == "changed", changed).otherwise(whole)).alias("c"))
    found = found.select("grp", "change", "id", "c.*")
    return found if only is None else found.where(F.col("change") == only)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("grp", "id", "ord")


def conclusion(found: DataFrame, scientific: Column, identical: Column) -> DataFrame:
    """One row ``(conclusion)``: differences, none, or none_detected.

    Differences if any scientific change; else none if what is ``identical`` (workspace bytes, attachments) is so
    for all; else none_detected. ``identical`` is judged on the change rows: true for a row that does not matter.
    """
    counted = found.agg(F.count_if(scientific).alias("s"), F.count_if(~identical).alias("o"))
    return counted.select(F.when(F.col("s") > 0, "differences").when(F.col("o") == 0, "none").otherwise("none_detected").alias("conclusion"))
