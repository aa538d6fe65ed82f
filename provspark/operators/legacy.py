"""Import of old processing records found in object metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metadata keys, and the roles each call pattern gives to its sources.
PROCESSING_KEY, ANALYSIS_KEY = "__processing_parameters", "__analysis_parameters"
PATTERN_ROLES = {"1-to-1": ["source"], "1-to-n": ["source"], "1-to-0": ["source"], "2-to-1": ["source", "operand"]}
#: Issues in the order they are listed.
ISSUES = ("record_unreadable", "missing_ancestry", "pattern_unknown", "unavailable_input", "unsupported_operation", "parameters_unreadable", "result_not_identified", "version_unknown", "version_mismatch", "output_not_observed")


def roles(pattern: Column, sources: Column) -> Column:
    """Roles of the sources of a record; an n-to-1 record names each ``sources``; null for an unknown pattern."""
    out = F.when(pattern == "n-to-1", F.array_repeat(F.lit("sources"), sources))
    for name, found in PATTERN_ROLES.items():
        out = out.when(pattern == name, F.array(*[F.lit(r) for r in found]))
    return out


def issues(tests: dict[str, Column]) -> Column:
    """The issues that hold, in the listed order, as an array."""
    listed = [F.when(tests[name], F.lit(name)) for name in ISSUES if name in tests]
    return F.array_compact(F.array(*listed))


def importable(objects: DataFrame, known: DataFrame) -> DataFrame:
    """Objects the ledger does not know yet."""
    return objects.join(known.select("object_uuid").distinct(), "object_uuid", "left_anti")


def source_missing(records: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """``(key, missing)``: whether any of a record's ``sources`` is not an object of the workspace."""
    named = records.select(key, F.explode_outer("sources").alias("object_uuid"))
    here = objects.select("object_uuid").distinct().withColumn("_here", F.lit(True))
    return named.join(here, "object_uuid", "left").groupBy(key).agg(F.max(F.col("object_uuid").isNotNull() & F.col("_here").isNull()).alias("missing"))


def summary(activities: DataFrame) -> DataFrame:
    """``(issue, n)``: how many legacy activities have each issue."""
    return activities.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def imported(records: DataFrame, objects: DataFrame, key: str, tests: dict[str, Column], sources: int = 2) -> DataFrame:
    """``records(key, pattern, sources, ...)`` as legacy activities: adds ``roles`` (null for an unknown pattern) and ``issues``.

    A source that is no object of the workspace, and an unknown pattern, are issues found here; ``tests`` names the others,
    as columns of ``records``. Nothing imported is ever replayed.
    """
    gone = source_missing(records, objects, key)
    found = roles(F.col("pattern"), F.lit(sources))
    every = tests | {"pattern_unknown": found.isNull(), "unavailable_input": F.col("missing")}
    return records.join(gone, key).select(*records.columns, found.alias("roles"), issues(every).alias("issues"))
