"""Ledgers: JSON documents as tables, validation, and appending what is recorded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provspark.functions import canon
from provspark.schemas import OPERATION, UUID

_ENVIRONMENT = "struct<edition:string,edition_version:string,edition_revision:string,python:struct<implementation:string,version:string>,platform:string,machine:string,pyodide:string,packages:map<string,string>>"
_STATE = "struct<state_id:string,object_uuid:string,kind:string,fingerprint:struct<scheme:string,value:string>,dtype:string,length:bigint,shape:array<bigint>,rows:array<string>,units:map<string,string>,limits:array<string>,roi:struct<definition:string,digest:string>,produced_by:string,sequence:bigint>"
_INPUT = "struct<role:string,binding:struct<state_id:string,object_uuids:array<string>,step:string>>"
_CALL = f"struct<operation:struct<id:string,contract_version:int>,parameters:string,inputs:array<{_INPUT}>>"
_OUTPUT = "struct<role:string,state_id:string,artifact:struct<kind:string,object_uuid:string,key:string,digest:string>>"
_ACTIVITY = f"struct<activity_id:string,command_id:string,call:{_CALL},implementation:struct<package:string,version:string,python_name:string>,outputs:array<{_OUTPUT}>,context:string,limits:array<string>,environment_id:string,edition:string,origin:string,status:string,started_at:string,finished_at:string,legacy:string>"
#: A ledger as JSON; parameters, context, legacy records and ROI definitions stay JSON text.
_ENVIRONMENTS, _STATES, _ACTIVITIES = f"environments map<string,{_ENVIRONMENT}>", f"states map<string,{_STATE}>", f"activities array<{_ACTIVITY}>"
DOCUMENT = f"workspace_id string, {_ENVIRONMENTS}, {_STATES}, {_ACTIVITIES}"
#: The origin of imported records, the kinds of objects, and how JSON names what it may not hold.
LEGACY, KINDS = "legacy_metadata", ("signal", "image")


class Ledgers:
    """The tables of many ledgers, one workspace each; ``tables`` may be replaced by stored ones."""

    def __init__(self, environments: DataFrame, states: DataFrame, activities: DataFrame):
        self.environments, self.states, self.activities = environments, states, activities

    @property
    def inputs(self) -> DataFrame:
        each = self.activities.select("workspace_id", "activity_id", F.posexplode("call.inputs").alias("position", "i"))
        return each.select("workspace_id", "activity_id", "position", "i.role", "i.binding.state_id", "i.binding.object_uuids", "i.binding.step")

    @property
    def outputs(self) -> DataFrame:
        each = self.activities.select("workspace_id", "activity_id", F.posexplode("outputs").alias("position", "o"))
        return each.select("workspace_id", "activity_id", "position", "o.role", "o.state_id", "o.artifact")


def from_json(documents: DataFrame, text: str = "text") -> Ledgers:
    """Ledgers out of JSON text, one a row; positions are those of the document. No shuffle; each table reads the text for itself."""
    parsed = lambda part: documents.select(F.from_json(text, f"workspace_id string, {part}").alias("d"))
    states = parsed(_STATES).select("d.workspace_id", F.posexplode("d.states").alias("pos", "key", "s"))
    states = states.select("workspace_id", F.col("key").alias("state_key"), F.col("pos").cast("long").alias("pos"), "s.*")
    states = states.select("*", F.col("fingerprint.scheme").alias("fp_scheme"), F.col("fingerprint.value").alias("fp_value"), F.col("roi.digest").alias("roi_digest"))
    activities = parsed(_ACTIVITIES).select("d.workspace_id", F.posexplode("d.activities").alias("ord", "a")).select("workspace_id", F.col("ord").cast("long").alias("ord"), "a.*")
    raw = F.from_json(text, "environments map<string,string>")["environments"].alias("raw")
    environments = documents.select(F.from_json(text, f"workspace_id string, {_ENVIRONMENTS}").alias("d"), raw).select("d.workspace_id", F.explode("d.environments").alias("environment_id", "e"), "raw")
    environments = environments.select("workspace_id", "environment_id", "e.*", F.try_element_at("raw", F.col("environment_id")).alias("record_json"))
    return Ledgers(environments, states, activities)


def to_json(ledgers: Ledgers) -> DataFrame:
    """``(workspace_id, text)``: each ledger whole, as one compact JSON document, in order; environments as they were recorded."""
    keep = lambda df, drop: F.struct(*[c for c in df.columns if c not in drop])
    plain = keep(ledgers.states, {"workspace_id", "state_key", "pos", "fp_scheme", "fp_value", "roi_digest"})

    def listed(rows: DataFrame, order: str, key: str, text: Column, out: str) -> DataFrame:
        each = F.sort_array(F.collect_list(F.struct(order, F.concat(canon.json_string(F.col(key)), F.lit(":"), text).alias("j"))))
        return rows.groupBy("workspace_id").agg(F.array_join(F.transform(each, lambda x: x["j"]), ",").alias(out))

    states = listed(ledgers.states, "pos", "state_id", F.to_json(plain), "states")
    homes = listed(ledgers.environments.dropDuplicates(["workspace_id", "environment_id"]), "environment_id", "environment_id", F.col("record_json"), "environments")
    acts = F.sort_array(F.collect_list(F.struct("ord", F.to_json(keep(ledgers.activities, {"workspace_id", "ord"})).alias("j"))))
    acts = ledgers.activities.groupBy("workspace_id").agg(F.array_join(F.transform(acts, lambda a: a["j"]), ",").alias("activities"))
    part = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(F.lit('{"workspace_id":'), canon.json_string(F.col("workspace_id")), F.lit(',"environments":{'), part("environments"), F.lit('},"states":{'), part("states"), F.lit('},"activities":['), part("activities"), F.lit("]}"))
    return states.join(acts, "workspace_id", "full_outer").join(homes, "workspace_id", "full_outer").select("workspace_id", text.alias("text"))


def call_problems(activities: DataFrame) -> DataFrame:
    """``(workspace_id, subject, problem)`` of malformed calls."""
    operation, legacy = F.col("call.operation"), F.col("origin") == LEGACY
    checks = [
        (F.col("call").isNull() | F.col("call.inputs").isNull(), "a call holds operation, parameters and inputs"),
        (operation.isNotNull() & ~F.coalesce(operation["id"].rlike(OPERATION), F.lit(False)), "invalid operation identifier"),
        (operation.isNotNull() & ~F.coalesce(operation["contract_version"] >= 1, F.lit(False)), "contract_version is an integer of 1 or more"),
        (F.col("call.parameters").isNotNull() & ~F.ltrim(F.col("call.parameters")).startswith("{"), "parameters are an object or null"),
        (F.exists("call.inputs", lambda i: F.coalesce(i["role"], F.lit("")) == ""), "a role is a non-empty text"),
        (F.exists("call.inputs", lambda i: _kinds(i) != 1), "a binding holds exactly one kind"),
        (F.exists("call.inputs", lambda i: i["binding"]["step"].isNotNull()), "step bindings are reserved"),
        (~legacy & F.exists("call.inputs", lambda i: i["binding"]["object_uuids"].isNotNull()), "object bindings are for legacy activities"),
        (legacy & F.exists("call.inputs", lambda i: i["binding"]["object_uuids"].isNotNull() & ((F.size(i["binding"]["object_uuids"]) < 1) | F.exists(i["binding"]["object_uuids"], lambda u: ~F.coalesce(u.rlike(UUID), F.lit(False))))), "object bindings list UUIDs"),
    ]
    return _listed(activities, F.col("activity_id"), checks)


def _kinds(item: Column) -> Column:
    return sum((F.when(item["binding"][k].isNotNull(), 1).otherwise(0) for k in ("state_id", "object_uuids", "step")), F.lit(0))


def _listed(rows: DataFrame, subject: Column, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in checks]))
    return rows.select("workspace_id", subject.alias("subject"), F.explode(found).alias("problem"))


def validate(ledgers: Ledgers) -> DataFrame:
    """``(workspace_id, subject, problem)``: every rule that the ledgers break, over all of them at once."""
    states, activities, outputs = ledgers.states, ledgers.activities, ledgers.outputs
    where = ["workspace_id", "state_id"]
    known = states.select("workspace_id", F.col("state_key").alias("state_id")).distinct()
    digest = canon.canonical_digest(F.col("record_json"))
    named = ledgers.environments.where(~digest.eqNullSafe(F.col("environment_id")))
    parts = [
        named.select("workspace_id", F.col("environment_id").alias("subject"), F.lit("identifier does not match").alias("problem")),
        _twice(states.where("sequence is not null"), "sequence", "state sequences are not unique"),
        _twice(activities, "activity_id", "duplicate activity_id"),
        call_problems(activities),
        ledgers.inputs.where("state_id is not null").join(known, where, "left_anti").select("workspace_id", F.col("activity_id").alias("subject"), F.lit("unknown input state").alias("problem")),
    ]
    opaque, legacy = F.col("call.operation").isNull(), F.col("origin") == LEGACY
    observed = F.get_json_object("legacy", "$.observed_state_id")
    parts.append(_listed(activities, F.col("activity_id"), [(legacy & ~opaque, "a legacy activity names no operation"), (opaque & F.col("implementation").isNull() & ~legacy, "an opaque call needs an implementation"), (legacy & (F.size("outputs") > 0), "a legacy activity has no output")]))
    parts.append(activities.where(legacy & observed.isNotNull()).select("workspace_id", "activity_id", observed.alias("state_id")).join(known, where, "left_anti").select("workspace_id", F.col("activity_id").alias("subject"), F.lit("unknown observed state").alias("problem")))
    homes = ledgers.environments.select("workspace_id", "environment_id").distinct()
    parts.append(activities.where("environment_id is not null").join(homes, ["workspace_id", "environment_id"], "left_anti").select("workspace_id", F.col("activity_id").alias("subject"), F.lit("unknown environment").alias("problem")))
    made = outputs.where("state_id is not null").select("workspace_id", "activity_id", "state_id")
    producer = states.select("workspace_id", F.col("state_key").alias("state_id"), "produced_by", F.lit(True).alias("_known"))
    times = made.groupBy(*where).agg(F.count("*").alias("_n"))
    checked = made.join(producer, where, "left").join(times, where)
    parts.append(_listed(checked, F.col("state_id"), [(F.col("_known").isNull(), "unknown output state"), (F.col("_known") & ~F.col("produced_by").eqNullSafe(F.col("activity_id")), "output state names another producer"), (F.col("_known") & (F.col("_n") > 1), "output state produced twice")]).distinct())
    parts.append(_listed(states, F.col("state_key"), [(~F.col("state_id").eqNullSafe(F.col("state_key")), "key does not match state_id"), (~F.col("kind").isin(*KINDS), "unknown kind")]))
    lists = made.select("workspace_id", "state_id", F.col("activity_id").alias("produced_by"))
    unlisted = states.where("produced_by is not null").select("workspace_id", F.col("state_key").alias("state_id"), "produced_by").join(lists, [*where, "produced_by"], "left_anti")
    parts.append(unlisted.select("workspace_id", F.col("state_id").alias("subject"), F.lit("producer does not list it as output").alias("problem")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _twice(rows: DataFrame, column: str, problem: str) -> DataFrame:
    counted = rows.groupBy("workspace_id", column).agg(F.count("*").alias("_n")).where("_n > 1")
    return counted.select("workspace_id", F.col(column).cast("string").alias("subject"), F.lit(problem).alias("problem"))


def with_environments(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known environments and those of ``new`` whose digest is not there; the first of equal ones."""
    fresh = new.dropDuplicates(["environment_id"]).join(known.select("environment_id"), "environment_id", "left_anti")
    return known.unionByName(fresh.select(*known.columns))


def record_states(known: DataFrame, observed: DataFrame) -> DataFrame:
    """States that ``observed(workspace_id, object_uuid, ord, kind, fp_scheme, fp_value, roi_digest, produced_by, fresh)``
    opens beside ``known``, with their sequence.

    An observation is a new state unless it is null-safe equal to the state of the object just before it, known or
    observed, in kind, fingerprint and ROI, has a fingerprint and is not ``fresh``. Sequences go on from the
    workspace's highest one in recording order.
    """
    content = ["kind", "fp_value", "roi_digest"]
    keys = ["workspace_id", "object_uuid"]
    at = F.coalesce("sequence", "pos")
    last = known.groupBy(*keys).agg(F.max_by(F.struct(*content), at).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("ord")
    before = F.struct(*[F.lag(c).over(order).alias(c) for c in content])
    rows = observed.join(last, keys, "left").withColumn("_first", F.row_number().over(order) == 1).withColumn("_before", F.when(F.row_number().over(order) == 1, F.col("_last")).otherwise(before))
    same = F.col("_before").isNotNull()
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"_before.{c}"))
    opened = rows.where(~same | F.col("fp_value").isNull() | F.coalesce("fresh", F.lit(False))).drop("_first", "_before", "_last", "fresh")
    ends = known.groupBy("workspace_id").agg(F.max(at).alias("_end"))
    number = F.row_number().over(Window.partitionBy("workspace_id").orderBy("ord"))
    return opened.join(ends, "workspace_id", "left").withColumn("sequence", F.coalesce("_end", F.lit(-1)) + number).drop("_end")


def held_until_named(pending: DataFrame, remap: DataFrame) -> DataFrame:
    """Activities whose temporary outputs got final ids, ``remap(temporary, final)``; those without one are dropped."""
    return pending.join(remap.withColumnRenamed("temporary", "object_uuid"), "object_uuid").drop("object_uuid").withColumnRenamed("final", "object_uuid")


def write_tables(found: Ledgers, path: str) -> None:
    """The three tables as Parquet under ``path``, which must not exist: nothing is ever written over."""
    for name in ("environments", "states", "activities"):
        getattr(found, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> Ledgers:
    return Ledgers(*(spark.read.parquet(f"{path}/{name}") for name in ("environments", "states", "activities")))
