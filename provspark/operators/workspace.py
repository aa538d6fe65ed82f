"""A workspace over its life: capture of executions, saving, loading, appending, and what its states and results are now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provspark.operators import check, history
from provspark.operators.graph import DEPTH
from provspark.operators.ledger import LEGACY, Ledgers, read_tables, record_states, write_tables

#: The limit that marks a state whose object took over a known identifier, and how a checked state is shown.
IDENTITY_LIMIT = "appended_without_provenance"
CONTENT = {"available": "matches", "changed": "differs", "altered": "differs", "missing": "absent", "unsupported": "unknown"}


def known_objects(states: DataFrame, holders: DataFrame | None = None, bound: DataFrame | None = None) -> DataFrame:
    """``(object_uuid)`` once each: objects of states, holders of old records, and objects that bindings name by themselves."""
    found = states.select("object_uuid")
    for more in (holders, bound):
        if more is not None:
            found = found.unionByName(more.select("object_uuid"))
    return found.where("object_uuid is not null").distinct()


def appended(objects: DataFrame, known: DataFrame) -> DataFrame:
    """Of appended ``objects(object_uuid, kind, ...)`` those whose identifier is taken, as fresh observations.

    Each opens a new state under the limit ``IDENTITY_LIMIT``: nothing recorded before is attributed to it. Objects
    of no kind, or without an identifier, are left out.
    """
    taken = objects.where("object_uuid is not null and kind is not null").join(known.select("object_uuid").distinct(), "object_uuid", "left_semi")
    return taken.withColumn("fresh", F.lit(True)).withColumn("limits", F.array(F.lit(IDENTITY_LIMIT)))


def artifact_holders(artifacts: DataFrame, inputs: DataFrame, states: DataFrame, breaks: DataFrame, live: DataFrame) -> DataFrame:
    """``artifacts(activity_id, position, object_uuid)`` with ``holder``: the live object that has the result, or null.

    The first input on the result's own object decides: if its state is from before the object's last identity
    break, ``breaks(object_uuid, broken_at)``, the live object is another one. Without such an input the live object is it.
    """
    analysed = inputs.where("state_id is not null").join(states.select("state_id", "object_uuid", "sequence"), "state_id")
    first = analysed.groupBy("activity_id", "object_uuid").agg(F.min_by("sequence", F.struct("position", "sequence")).alias("_sequence"))
    here = live.select("object_uuid").distinct().withColumn("_live", F.lit(True))
    joined = artifacts.join(first, ["activity_id", "object_uuid"], "left").join(breaks.select("object_uuid", "broken_at"), "object_uuid", "left").join(here, "object_uuid", "left")
    gone = F.coalesce(F.col("_sequence") < F.col("broken_at"), F.lit(False))
    return joined.withColumn("holder", F.when(F.col("_live") & ~gone, F.col("object_uuid"))).select(*artifacts.columns, "holder")


def analysis_holders(activities: DataFrame, outputs: DataFrame, inputs: DataFrame, states: DataFrame) -> DataFrame:
    """``(activity_id, ord, object_uuid)``: objects that an analysis belongs to, each once, where it first stands.

    An analysis is a recorded activity without a state among its outputs. Its holders are those of its artifacts, in
    order, then the objects of its input states.
    """
    made = outputs.where("state_id is not null").select("activity_id").distinct()
    analyses = activities.where(F.col("origin") != LEGACY).select("activity_id").join(made, "activity_id", "left_anti")
    kept = outputs.where("artifact is not null").select("activity_id", F.lit(0).alias("side"), "position", F.col("artifact.object_uuid").alias("object_uuid"))
    read = inputs.where("state_id is not null").join(states.select("state_id", "object_uuid"), "state_id").select("activity_id", F.lit(1).alias("side"), "position", "object_uuid")
    first = kept.unionByName(read).join(analyses, "activity_id", "left_semi").groupBy("activity_id", "object_uuid").agg(F.min(F.struct("side", "position")).alias("_at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("activity_id").orderBy("_at")) - 1).select("activity_id", "ord", "object_uuid")


def capture(known: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(states, bindings)`` that a recording of executions adds to the states ``known``.

    ``uses(workspace_id, ord, activity_id, side, role, object_uuid, kind, fp_scheme, fp_value, roi_digest)`` lists the
    inputs and outputs (``side``) in recording order. An input is observed: it takes the object's latest state if
    that has the same content, else opens one. An output always opens a state that the activity produced.
    ``states`` are those opened, with their sequence; ``bindings(workspace_id, activity_id, side, ord, role, sequence,
    state_id)`` name the state each use binds: a known one by its id, a new one by its sequence.
    """
    made = F.col("side") == "output"
    observed = uses.withColumn("produced_by", F.when(made, F.col("activity_id"))).withColumn("fresh", made)
    opened = record_states(known, observed)
    at = ["workspace_id", "object_uuid", "ord"]
    last = known.groupBy("workspace_id", "object_uuid").agg(F.max_by(F.struct("state_id", F.coalesce("sequence", "pos").alias("sequence")), F.coalesce("sequence", "pos")).alias("_known"))
    joined = uses.join(opened.select(*at, "sequence"), at, "left").join(last, at[:2], "left")
    so_far = Window.partitionBy(*at[:2]).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    new = F.last("sequence", ignorenulls=True).over(so_far)
    bound = joined.withColumn("_new", new)
    state = F.when(F.col("_new").isNull(), F.col("_known.state_id"))
    bindings = bound.select("workspace_id", "activity_id", "side", "ord", "role", F.coalesce("_new", "_known.sequence").alias("sequence"), state.alias("state_id"))
    return opened, bindings


def saved(ledgers: Ledgers, objects: DataFrame, facts: DataFrame) -> DataFrame:
    """``(state_id, kind, path)``: locators a saved workspace gets: latest states whose objects are there as recorded."""
    latest = history.latest_states(ledgers.states)
    places = check.located(latest, objects)
    bad = check.altered(latest.join(places.select("state_id"), "state_id", "left_semi"), facts)
    return places.join(bad.select("state_id"), "state_id", "left_anti")


def save(ledgers: Ledgers, locators: DataFrame, path: str, origin: DataFrame | None = None) -> None:
    """The ledger's tables, its locators and the capsule it came from, under a new ``path``."""
    write_tables(ledgers, path)
    locators.write.mode("errorifexists").parquet(f"{path}/locators")
    if origin is not None:
        origin.write.mode("errorifexists").parquet(f"{path}/origin")


def load(spark: SparkSession, path: str, facts: DataFrame) -> tuple[Ledgers, DataFrame]:
    """A saved workspace: its ledger, and its states with ``status``: unavailable, altered or null."""
    ledgers, locators = read_tables(spark, path), spark.read.parquet(f"{path}/locators")
    placed = ledgers.states.join(locators.select("state_id").distinct(), "state_id", "left_semi")
    return ledgers, check.file_status(ledgers.states, locators, check.altered(placed, facts))


def descriptions(states: DataFrame, live: DataFrame, facts: DataFrame, checked: Column | None = None, breaks: DataFrame | None = None) -> DataFrame:
    """``states`` with what an inspection shows: ``present``, ``latest``, ``content`` and ``limits``.

    ``states(state_id, object_uuid, kind, sequence, fp_value, roi_digest, status, depth)``; ``live(object_uuid)``;
    ``facts(object_uuid, fp_value, roi_digest)`` of the live objects. Content is compared where ``checked`` holds or
    the object is gone, else ``unchecked``. ``depth`` is how many states were expanded above this one.
    """
    here = live.select("object_uuid").distinct().withColumn("_live", F.lit(True))
    now = facts.select("object_uuid", F.col("fp_value").alias("_fp"), F.col("roi_digest").alias("_roi"))
    newest = states.groupBy("object_uuid").agg(F.max("sequence").alias("_last"))
    joined = states.join(here, "object_uuid", "left").join(now, "object_uuid", "left").join(newest, "object_uuid")
    held = F.col("_live")
    if breaks is not None:
        joined = joined.join(breaks.select("object_uuid", "broken_at"), "object_uuid", "left")
        held = held & ~F.coalesce(F.col("sequence") < F.col("broken_at"), F.lit(False))
    present = F.coalesce(held, F.lit(False))
    same = check.same_state(F.col("fp_value"), F.col("_fp"), F.col("roi_digest"), F.col("_roi"), F.col("status"))
    found = F.when(~present, "missing").otherwise(same)
    shown = found
    for code, text in CONTENT.items():
        shown = F.when(found == code, text).otherwise(shown)
    looked = ~present if checked is None else ~present | checked
    limits = F.array_compact(F.array(F.when(F.col("depth") >= DEPTH, "depth_limit")))
    return joined.select(*states.columns, present.alias("present"), (F.col("sequence") == F.col("_last")).alias("latest"), F.when(looked, shown).otherwise("unchecked").alias("content"), limits.alias("limits"))


def object_summaries(states: DataFrame, analyses: DataFrame, key: str, order: str, content: str, most: int = 20) -> DataFrame:
    """``(key, latest, content, states, states_truncated, analyses)``: what is shown first of each object.

    ``states`` are opened ones with ``state_no`` counting from 1; ``analyses(key)`` has a row for each analysis.
    """
    newest = history.latest(states, key, ["state_no"]).select(key, F.col(order).alias("latest"), F.col(content).alias("content"), F.col("state_no").alias("states"))
    counted = analyses.groupBy(key).agg(F.count("*").alias("analyses"))
    shown = [key, "latest", "content", "states", (F.col("states") > most).alias("states_truncated"), F.coalesce("analyses", F.lit(0)).cast("long").alias("analyses")]
    return newest.join(counted, key, "left").select(*shown)


def support(opaque: Column, known: Column, compatible: Column) -> Column:
    """How a recorded call stands to the contracts at hand: opaque, unknown, incompatible or known."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return check.cascade((F.coalesce(opaque, F.lit(False)), "opaque"), (no(known), "unknown"), (no(compatible), "incompatible"), otherwise="known")


def activity_summaries(activities: DataFrame, inputs: DataFrame, most: int = 200) -> DataFrame:
    """``activities(activity_id, ...)`` with ``input_count``, ``inputs_shown`` and ``inputs_truncated``; inputs are counted before they are joined."""
    sizes = inputs.groupBy("activity_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return activities.join(sizes, "activity_id", "left").select(*activities.columns, n.alias("input_count"), F.least(n, F.lit(most)).alias("inputs_shown"), (n > most).alias("inputs_truncated"))
