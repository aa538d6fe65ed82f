"""Whether recorded activities can be verified: ordered refusals, as one cascade over joined tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.operators.check import cascade, same_state

#: Refusals in the order they are tried.
REFUSALS = ("unsupported_operation", "unsupported_contract", "missing_input", "unsupported_context", "input_changed", "invalid_parameters")


#: What an error of the computing library means for replay, by its kind and, for executions, its code.
ERRORS = {"unknown_operation": "unsupported_operation", "incompatible_contract": "unsupported_contract", "invalid_parameters": "invalid_parameters", "x_alignment": "unsupported_context"}
EXECUTIONS = {"invalid_parameters": "invalid_parameters", "input_mismatch": "unsupported_context", "unsupported_context": "unsupported_context"}


def refusal_of_error(kind: Column, code: Column) -> Column:
    """The refusal that an error stands for, or null: a fault of its own, not a refusal."""
    known = cascade(*[(kind == k, r) for k, r in ERRORS.items()])
    return F.when(kind == "execution", cascade(*[(code == k, r) for k, r in EXECUTIONS.items()])).otherwise(known)


def input_status(inputs: DataFrame, live: DataFrame) -> DataFrame:
    """``inputs(activity_id, position, state_id, object_uuid, fp_value, roi_digest, restorable[, file_status])`` beside the live
    objects ``(object_uuid, fp_now, roi_now)``: adds ``status`` missing, unsupported, altered, changed, roi_changed or available.

    ``file_status`` is that of the state when its workspace was opened; a state altered in the file is altered whatever
    the live data are.
    """
    now = live.select("object_uuid", "fp_now", "roi_now").withColumn("_live", F.lit(True))
    file_status = F.col("file_status") if "file_status" in inputs.columns else None
    same = same_state(F.when(F.col("fp_now").isNotNull(), F.col("fp_value")), F.col("fp_now"), F.col("roi_digest"), F.col("roi_now"), file_status)
    status = F.when(F.col("_live").isNull(), "missing").otherwise(same)
    return inputs.join(now, "object_uuid", "left").withColumn("status", status).drop("_live", "fp_now", "roi_now")


def input_refusals(statuses: DataFrame) -> DataFrame:
    """``(activity_id, input_refusal, at)``: of each activity, a missing input before all else, then the first other
    input that stands in the way. A restorable ROI change does not.
    """
    code = cascade(
        (F.col("status") == "missing", "missing_input"),
        (F.col("status") == "unsupported", "unsupported_context"),
        ((F.col("status") == "roi_changed") & ~F.coalesce("restorable", F.lit(False)), "input_changed"),
        (F.col("status").isin("changed", "altered"), "input_changed"),
    )
    bad = statuses.withColumn("_code", code).where("_code is not null")
    order = F.struct(F.when(F.col("_code") == "missing_input", 0).otherwise(1).alias("late"), F.col("position"))
    return bad.groupBy("activity_id").agg(F.min_by("_code", order).alias("input_refusal"), F.min_by("position", order).alias("at"))


def eligibility(activities: DataFrame, contracts: DataFrame, refusals: DataFrame, context_ok: Column, parameters_ok: Column) -> DataFrame:
    """``activities`` with ``eligibility``: the first refusal that holds, or ``ready``.

    ``activities(activity_id, operation_id, contract_version)``; ``contracts(operation_id, contract_version, qualified)``
    is a stated list. An opaque activity has no operation.
    """
    known = contracts.select("operation_id", "contract_version", "qualified")
    joined = activities.join(known, ["operation_id", "contract_version"], "left").join(refusals, "activity_id", "left")
    verdict = cascade(
        (F.col("operation_id").isNull(), "unsupported_operation"),
        (~F.coalesce("qualified", F.lit(False)), "unsupported_contract"),
        (F.col("input_refusal") == "missing_input", "missing_input"),
        (F.col("input_refusal").isNotNull(), None),
        (~context_ok, "unsupported_context"),
        (~parameters_ok, "invalid_parameters"),
        otherwise="ready",
    )
    return joined.withColumn("eligibility", F.coalesce(verdict, "input_refusal")).drop("qualified")


def context_refusals(reads: DataFrame, current: DataFrame) -> DataFrame:
    """Metadata an activity read, ``reads(activity_id, position, key, digest)``, against the digests of now.

    ``(activity_id, position, key, status)``: matches, changed, missing, or unknown without a recorded digest.
    """
    now = current.select("position", "key", "activity_id", F.col("digest").alias("_now"))
    status = cascade((F.col("digest").isNull(), "unknown"), (F.col("_now").isNull(), "missing"), (F.col("digest") == F.col("_now"), "matches"), otherwise="changed")
    return reads.join(now, ["activity_id", "position", "key"], "left").select("activity_id", "position", "key", status.alias("status"))


def filled_outputs(recorded: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded outputs beside candidate outputs by role; a role only one side has stands against ``none``."""
    a = recorded.select(*keys, "role", F.col("value").alias("recorded"))
    b = candidates.select(*keys, "role", F.col("value").alias("candidate"))
    return a.join(b, [*keys, "role"], "full_outer").select(*keys, "role", F.coalesce("recorded", F.lit("none")).alias("recorded"), F.coalesce("candidate", F.lit("none")).alias("candidate"))
