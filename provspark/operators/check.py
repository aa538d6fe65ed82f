"""Status cascades and membership checks shared by inspection, replay and verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(None).cast("string")
    chosen = None
    for test, name in rules:
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    return out if chosen is None else chosen.otherwise(F.lit(otherwise))


def same_state(fp: Column, now: Column, roi: Column, roi_now: Column, file_status: Column | None = None) -> Column:
    """The one meaning of "the same state": unsupported, altered, changed, roi_changed or available, in this order."""
    altered = F.lit(False) if file_status is None else F.coalesce(file_status == "altered", F.lit(False))
    return cascade((fp.isNull(), "unsupported"), (altered, "altered"), (~fp.eqNullSafe(now), "changed"), (~roi.eqNullSafe(roi_now), "roi_changed"), otherwise="available")


def artifact_status(recorded: Column, current: Column) -> Column:
    """Of an analysis result: missing without a current digest, available if equal, else replaced."""
    return cascade((current.isNull(), "missing"), (recorded == current, "available"), otherwise="replaced")


def output_status(present: Column, file_status: Column, compared: Column) -> Column:
    """Of a recorded output state: missing, available or altered."""
    gone = ~F.coalesce(present, F.lit(False)) | F.coalesce(file_status == "unavailable", F.lit(False))
    return cascade((gone, "missing"), (compared == "available", "available"), otherwise="altered")


def located(latest: DataFrame, objects: DataFrame) -> DataFrame:
    """Locators ``(state_id, kind, path)`` of the latest states that are saved: same object and kind, with a fingerprint."""
    saved = objects.select("object_uuid", "kind", "path")
    return latest.where("fp_value is not null").join(saved, ["object_uuid", "kind"]).select("state_id", "kind", "path")


def altered(located_states: DataFrame, facts: DataFrame) -> DataFrame:
    """Located states whose saved data no longer give the recorded fingerprint or ROI digest."""
    now = facts.select("object_uuid", F.col("fp_value").alias("_fp"), F.col("roi_digest").alias("_roi"))
    joined = located_states.join(now, "object_uuid")
    return joined.where(~F.col("fp_value").eqNullSafe(F.col("_fp")) | ~F.col("roi_digest").eqNullSafe(F.col("_roi"))).drop("_fp", "_roi")


def file_status(states: DataFrame, locators: DataFrame, altered_ids: DataFrame) -> DataFrame:
    """``states`` with ``status``: unavailable without a locator, altered, or null."""
    where = locators.select("state_id").distinct().withColumn("_located", F.lit(True))
    bad = altered_ids.select("state_id").distinct().withColumn("_altered", F.lit(True))
    joined = states.join(where, "state_id", "left").join(bad, "state_id", "left")
    return joined.withColumn("status", cascade((F.col("_located").isNull(), "unavailable"), (F.col("_altered").isNotNull(), "altered"))).drop("_located", "_altered")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with how often as ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows whose non-null ``column`` names nothing known."""
    ids = known.select(F.col(known_column).alias("_known")).distinct()
    return rows.where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_known"), "left_anti")


def problems(rule: str, rows: DataFrame, subject: str) -> DataFrame:
    """``(subject, problem)`` rows of one validation rule."""
    return rows.select(F.col(subject).cast("string").alias("subject"), F.lit(rule).alias("problem"))


def all_problems(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def message(found: DataFrame, most: int = 5) -> DataFrame:
    """One row: the number of problems, and the first ``most`` by subject and problem as one text."""
    first = found.orderBy("subject", "problem").limit(most)
    text = first.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "subject", "problem"))), "; ").alias("message"))
    return text.select(found.agg(F.count("*")).scalar().alias("problems"), "message")


def assert_valid(found: DataFrame, most: int = 5) -> None:
    """Raise if there are problems, naming the first few."""
    first = found.orderBy("subject", "problem").limit(most).collect()
    if first:
        raise ValueError("; ".join(f"{r.subject}: {r.problem}" for r in first))


def declared_against_present(declared: DataFrame, present: DataFrame) -> DataFrame:
    """``(name, status)``: missing, undeclared, altered (size or sha256) or available; matched by name."""
    d = declared.select("name", F.col("sha256").alias("_want"), F.col("size").alias("_size"))
    p = present.select("name", F.col("sha256").alias("_have"), F.col("size").alias("_bytes"))
    status = cascade(
        (F.col("_bytes").isNull() & F.col("_have").isNull(), "missing"),
        (F.col("_want").isNull() & F.col("_size").isNull(), "undeclared"),
        (~F.col("_want").eqNullSafe(F.col("_have")) | ~F.col("_size").eqNullSafe(F.col("_bytes")), "altered"),
        otherwise="available",
    )
    return d.join(p, "name", "full_outer").select("name", status.alias("status"))


def object_index(objects: DataFrame) -> DataFrame:
    """``(object_uuid, kind, path, n, duplicated)``: where each object is saved; one that stands twice is an error of the file."""
    found = objects.groupBy("object_uuid").agg(F.min("kind").alias("kind"), F.min("path").alias("path"), F.count("*").alias("n"))
    return found.withColumn("duplicated", F.col("n") > 1)


def has_block(workspaces: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(workspace_id, present)``: whether a workspace has a block of provenance."""
    there = blocks.select("workspace_id").distinct().withColumn("_there", F.lit(True))
    return workspaces.select("workspace_id").distinct().join(there, "workspace_id", "left").select("workspace_id", F.coalesce("_there", F.lit(False)).alias("present"))


def shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, once each; none if they are disjoint."""
    return left.intersect(right)


def timings(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, median, least, most)`` of measured values, the median exact."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def without(found: DataFrame, rejected: DataFrame) -> DataFrame:
    """Problems less those of rejected documents, each as often as it stands there: what is left is the capsule's own."""
    return found.exceptAll(rejected)
