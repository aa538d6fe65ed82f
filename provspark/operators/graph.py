"""The provenance graph: consumers, fan-out, ancestry, revision chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.scratch import materialize, scratch_path

#: Fixed value: the deepest ancestry that is shown.
DEPTH = 64


def consumers(states: DataFrame, inputs: DataFrame) -> DataFrame:
    """``(state_id, consumers)``: one entry for each input that binds the state, so an activity may count twice."""
    uses = inputs.groupBy("state_id").agg(F.count("activity_id").alias("consumers"))
    return states.select("state_id").join(uses, "state_id", "left").select("state_id", F.coalesce("consumers", F.lit(0)).cast("long").alias("consumers"))


def fan_out(inputs: DataFrame) -> DataFrame:
    """States that more than one input binds."""
    return inputs.where("state_id is not null").groupBy("state_id").agg(F.count("*").alias("consumers")).where("consumers > 1")


def produced_by(states: DataFrame, outputs: DataFrame) -> DataFrame:
    """``states`` with ``producer``: the activity that lists the state as an output, null if observed."""
    made = outputs.where("state_id is not null").select("state_id", F.col("activity_id").alias("producer"))
    return states.join(made, "state_id", "left")


def ancestry(edges: DataFrame, start: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(start, node, depth)`` of all nodes reached over ``edges(child, parent)`` within ``depth`` steps, each once, at
    its least depth. Cycles end, as a node once reached for a start is not walked again.

    One join a level, of the frontier alone; every level is a table in the shared folder, so plans stay short
    and a lost executor costs one level.
    """
    spark, base = edges.sparkSession, scratch_path(edges.sparkSession, "ancestry")
    up = materialize(edges.where("child is not null and parent is not null").select(F.col("child").alias("node"), "parent").distinct(), "edges")
    first = F.col(start.columns[0])
    frontier = start.where(first.isNotNull()).select(first.alias("start"), first.alias("node"), F.lit(0).alias("depth")).distinct()
    schema = frontier.schema
    for level in range(depth + 1):
        frontier.write.option("compression", "zstd").parquet(f"{base}/{level}")
        frontier = spark.read.schema(schema).parquet(f"{base}/{level}")
        if frontier.isEmpty():
            break
        reached = spark.read.schema(schema).parquet(*[f"{base}/{i}" for i in range(level + 1)])
        step = frontier.join(up, "node").select("start", F.col("parent").alias("node"), F.lit(level + 1).alias("depth")).distinct()
        frontier = step.join(reached.select("start", "node"), ["start", "node"], "left_anti")
    return spark.read.schema(schema).parquet(*[f"{base}/{i}" for i in range(level + 1)])


ANCESTRY_SQL = """
with recursive walk(start, node, depth, trail) as (
  select {start}, {start}, 0, array({start}) from {starts}
  union all
  select w.start, e.parent, w.depth + 1, array_append(w.trail, e.parent)
  from walk w join {edges} e on e.child = w.node
  where w.depth < {depth} and not array_contains(w.trail, e.parent)
) select start, node, min(depth) as depth from walk group by start, node
"""


def ancestry_sql(edges: DataFrame, start: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``ancestry`` as one recursive query; for shallow graphs, as it lists every path."""
    edges.createOrReplaceTempView("_edges")
    start.createOrReplaceTempView("_starts")
    return edges.sparkSession.sql(ANCESTRY_SQL.format(start=start.columns[0], starts="_starts", edges="_edges", depth=depth))


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``(start, node, depth)`` of every node reached over ``edges(child, parent)`` from any other, at its least depth.

    Distances double: pairs exactly as far apart as has been walked are joined to all pairs known, so the rounds are the
    logarithm of the longest way. Cycles end, as known pairs are not walked again. Every round is a table in the shared
    folder.
    """
    pairs = edges.where("child is not null and parent is not null and child <> parent").select(F.col("child").alias("start"), F.col("parent").alias("node")).distinct()
    reach, far, span = None, materialize(pairs.withColumn("depth", F.lit(1)), "closure"), 1
    while not far.isEmpty():
        reach = far if reach is None else reach.unionByName(far)
        if depth is not None and span >= depth:
            break
        edge = far.where(F.col("depth") == span).select("start", F.col("node").alias("_via"))
        more = edge.join(reach.select(F.col("start").alias("_via"), "node", (F.col("depth") + span).alias("depth")), "_via").where("start <> node")
        least = more.groupBy("start", "node").agg(F.min("depth").alias("depth"))
        far = materialize(least.join(reach.select("start", "node"), ["start", "node"], "left_anti"), "closure")
        span *= 2
    reach = far if reach is None else reach
    return reach if depth is None else reach.where(F.col("depth") <= depth)


def ancestries(edges: DataFrame, start: DataFrame, depth: int | None = DEPTH) -> DataFrame:
    """``ancestry`` for many starts, by ``closure``: few rounds for long ways, at the cost of pairs between all nodes."""
    first = F.col(start.columns[0])
    own = start.where(first.isNotNull()).select(first.alias("start")).distinct()
    reached = closure(edges, depth).join(own, "start", "left_semi")
    return own.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).unionByName(reached.select("start", "node", "depth"))


def chain(revisions: DataFrame, key: str = "fingerprint", parent: str = "revision_of", depth: int | None = None) -> DataFrame:
    """``(start, node, depth)``: each revision and all those it stems from, however many they are."""
    edges = revisions.where(F.col(parent).isNotNull()).select(F.col(key).alias("child"), F.col(parent).alias("parent"))
    return ancestries(edges, revisions.select(key), depth)
