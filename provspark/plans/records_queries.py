"""Readings of orders and lines as recorded activities: validation, eligibility, legacy records, manifest entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.catalog import Tables, query
from provspark.operators import check, legacy, manifest, replay
from provspark.functions import canon


@query("""
with o as (select o_orderkey from orders where o_orderkey % 10 <> 0), s as (select s_suppkey from supplier where s_suppkey % 4 <> 1),
k as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all)
select cast(l_orderkey as varchar) as subject, 'unknown activity' as problem, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from o) group by all
union all select cast(l_suppkey as varchar), 'unknown environment', count(*) from lineitem where l_suppkey not in (select s_suppkey from s) group by all
union all select l_orderkey || '/' || l_linenumber, 'produced twice', n from k where n > 1
""")
def validate_ledger_refs(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    lost = check.dangling(lines, "l_orderkey", t.orders.where("o_orderkey % 10 <> 0"), "o_orderkey")
    homeless = check.dangling(lines, "l_suppkey", t.supplier.where("s_suppkey % 4 <> 1"), "s_suppkey")
    twice = check.duplicates(lines, ["l_orderkey", "l_linenumber"])
    counted = lambda df: df.groupBy("subject", "problem").agg(F.count("*").alias("n"))
    named = twice.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("subject"), F.lit("produced twice").alias("problem"), "n")
    return counted(check.problems("unknown activity", lost, "l_orderkey")).unionByName(counted(check.problems("unknown environment", homeless, "l_suppkey"))).unionByName(named)


_PROBLEMS = """
p as (select cast(l_orderkey as varchar) as subject, 'unknown activity' as problem from lineitem where l_orderkey % 10 = 0)
"""


@query(f"with {_PROBLEMS}, f as (select subject, problem from p order by subject, problem limit 5) select (select count(*) from p) as problems, (select string_agg(subject || ': ' || problem, '; ' order by subject || ': ' || problem) from f) as message")
def ledger_message(t: Tables) -> DataFrame:
    lost = check.dangling(t.lineitem, "l_orderkey", t.orders.where("o_orderkey % 10 <> 0"), "o_orderkey")
    return check.message(check.problems("unknown activity", lost, "l_orderkey"))


@query(f"with {_PROBLEMS}, d as (select cast(o_orderkey as varchar) as subject, 'unknown activity' as problem from orders where o_orderkey % 20 = 0) select * from p except all select * from d")
def document_partition(t: Tables) -> DataFrame:
    lost = check.problems("unknown activity", t.lineitem.where("l_orderkey % 10 = 0"), "l_orderkey")
    rejected = check.problems("unknown activity", t.orders.where("o_orderkey % 20 = 0"), "o_orderkey")
    return check.without(lost, rejected)


@query("""
select o_orderkey as activity_id, case when o_orderstatus = 'P' then 'unsupported_operation' when o_custkey % 10 in (0, 1) then 'unsupported_contract'
 when c_custkey is null or c_custkey % 17 = 0 then 'missing_input' when c_acctbal < 0 then 'unsupported_context' when c_mktsegment = 'BUILDING' then 'input_changed'
 when o_orderpriority like '1%' then 'unsupported_context' when o_totalprice > 400000 then 'invalid_parameters' else 'ready' end as eligibility
from orders left join customer on o_custkey = c_custkey
""")
def replay_eligibility(t: Tables) -> DataFrame:
    calls = t.orders.select(
        F.col("o_orderkey").alias("activity_id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("op"), (F.col("o_custkey") % 10).cast("string"))).alias("operation_id"),
        F.lit(1).alias("contract_version"), "o_custkey", "o_orderpriority", "o_totalprice",
    )
    spark = t.spark
    contracts = spark.range(1, 10).select(F.concat(F.lit("op"), F.col("id").cast("string")).alias("operation_id"), F.lit(1).alias("contract_version"), (F.col("id") != 1).alias("qualified"))
    inputs = calls.select("activity_id", F.lit(0).alias("position"), F.col("o_custkey").alias("object_uuid"), F.lit("fp").alias("fp_value"), F.lit(None).cast("string").alias("roi_digest"), F.lit(False).alias("restorable"))
    live = t.customer.where("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("object_uuid"), F.when(F.col("c_acctbal") < 0, None).when(F.col("c_mktsegment") == "BUILDING", "other").otherwise("fp").alias("fp_now"), F.lit(None).cast("string").alias("roi_now"))
    refusals = replay.input_refusals(replay.input_status(inputs, live))
    return replay.eligibility(calls, contracts, refusals, ~F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") <= 400000).select("activity_id", "eligibility")


@query("""
select event_id, user_id, case when cast(json_extract(props, '$.n') as bigint) is null then 'unknown' when p.n is null then 'missing' when p.n = e.n then 'matches' else 'changed' end as status from
(select *, cast(json_extract(props, '$.k') as bigint) as n from events) e left join (select event_id + 1 as event_id, cast(json_extract(props, '$.k') as bigint) as n from events) p using (event_id)
""".replace("cast(json_extract(props, '$.n') as bigint) is null", "e.n is null"))
def metadata_checks(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    reads = t.events.select(F.col("event_id").alias("activity_id"), F.lit(0).alias("position"), F.lit("k").alias("key"), k.alias("digest"), "user_id")
    now = t.events.select((F.col("event_id") + 1).alias("activity_id"), F.lit(0).alias("position"), F.lit("k").alias("key"), k.alias("digest"))
    found = replay.context_refusals(reads, now)
    return found.join(reads.select("activity_id", "user_id"), "activity_id").select(F.col("activity_id").alias("event_id"), "user_id", "status")


@query("""
select coalesce(a.l_partkey, b.l_partkey) as role, coalesce(a.n, 'none') as recorded, coalesce(b.n, 'none') as candidate from
(select l_partkey, cast(count(*) as varchar) as n from lineitem where l_returnflag = 'R' group by 1) a full outer join (select l_partkey, cast(count(*) as varchar) as n from lineitem where l_returnflag = 'A' group by 1) b on a.l_partkey = b.l_partkey
""")
def outputs_by_role(t: Tables) -> DataFrame:
    side = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("role")).agg(F.count("*").cast("string").alias("value")).withColumn("g", F.lit(1))
    return replay.filled_outputs(side("R"), side("A"), ["g"]).drop("g")


def _legacy(t: Tables) -> DataFrame:
    """Events as old records: the type is the pattern, props.k the source, sources over 90 are gone."""
    k = F.get_json_object("props", "$.k").cast("long")
    pattern = F.when(F.col("event_type") == "purchase", "2-to-1").when(F.col("event_type") == "signup", "odd").when(F.col("event_type") == "click", "n-to-1").otherwise("1-to-1")
    return t.events.select("event_id", "user_id", k.alias("k"), pattern.alias("pattern"))


_LEGACY = """
l as (select event_id, user_id, cast(json_extract(props, '$.k') as bigint) as k, case event_type when 'purchase' then '2-to-1' when 'signup' then 'odd' when 'click' then 'n-to-1' else '1-to-1' end as pattern from events),
i as (select event_id, pattern, list_filter([case when k = 0 then 'missing_ancestry' end, case when pattern = 'odd' then 'pattern_unknown' end, case when k > 90 then 'unavailable_input' end,
 case when user_id % 5 = 0 then 'unsupported_operation' end, case when k % 8 = 3 then 'version_mismatch' end], lambda x: x is not null) as issues from l)
"""


def _imported(t: Tables) -> DataFrame:
    records = _legacy(t).withColumn("sources", F.array("k"))
    objects = t.spark.range(0, 91).select(F.col("id").alias("object_uuid"))
    tests = {"missing_ancestry": F.col("k") == 0, "unsupported_operation": F.col("user_id") % 5 == 0, "version_mismatch": F.col("k") % 8 == 3}
    return legacy.imported(records, objects, "event_id", tests)


@query(f"with {_LEGACY} select event_id, pattern, case pattern when '2-to-1' then 'source,operand' when 'n-to-1' then 'sources,sources' when '1-to-1' then 'source' end as roles, array_to_string(issues, ',') as issues from i")
def legacy_import(t: Tables) -> DataFrame:
    return _imported(t).select("event_id", "pattern", F.array_join("roles", ",").alias("roles"), F.array_join("issues", ",").alias("issues"))


@query(f"with {_LEGACY} select issue, count(*) as n from (select unnest(issues) as issue from i) group by issue")
def legacy_summary(t: Tables) -> DataFrame:
    return legacy.summary(_imported(t))


@query("select p_partkey as object_uuid from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45 and l_partkey is not null)")
def legacy_unknown_objects(t: Tables) -> DataFrame:
    known = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("object_uuid"))
    return legacy.importable(t.part.select(F.col("p_partkey").alias("object_uuid")), known)


@query("""
with b as (select l_orderkey, l_partkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem)
select '#activity-' || l_orderkey || '-input-' || pos as id, 'dlc:RoleBinding' as type, case l_returnflag when 'R' then 'operand' else 'source' end as name, pos as position, '#state-' || l_partkey as target from b
union all select '#activity-' || o_orderkey, 'CreateAction', o_orderpriority, null, null from orders
""")
def manifest_entities(t: Tables) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")))
    called = t.lineitem.groupBy(F.col("l_orderkey").alias("activity_id")).agg(lines.alias("x"))
    bound = F.transform("x", lambda x: F.struct(F.when(x["l_returnflag"] == "R", "operand").otherwise("source").alias("role"), x["l_partkey"].cast("string").alias("state_id")))
    bindings = manifest.binding_entities(called.select("activity_id", bound.alias("bindings")), "input")
    actions = t.orders.select(manifest.activity_ref(F.col("o_orderkey")).alias("id"), F.lit("CreateAction").alias("type"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("target"))
    return bindings.unionByName(actions)


@query("select doc_id, 'sha256:' || sha256(source) as recorded, case when quality is null then 'missing' when quality = 1 then 'available' else 'replaced' end as status from documents left join labels using (doc_id)")
def artifact_status(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    recorded = canon.binary_digest(F.encode("source", "UTF-8"))
    now = F.when(F.col("quality") == 1, recorded).when(F.col("quality") == 0, "sha256:other")
    return joined.select("doc_id", recorded.alias("recorded"), check.artifact_status(recorded, now).alias("status"))


@query("select o_orderkey, case when o_custkey % 5 = 0 then 'unsupported' when o_orderstatus = 'P' then 'altered' when o_orderpriority like '3%' then 'changed' when o_custkey % 7 = 1 then 'roi_changed' else 'available' end as status from orders")
def same_state(t: Tables) -> DataFrame:
    fp = F.when(F.col("o_custkey") % 5 != 0, "a")
    now = F.when(F.col("o_orderpriority").startswith("3"), "b").otherwise("a")
    roi = F.when(F.col("o_custkey") % 7 == 1, "r")
    file = F.when(F.col("o_orderstatus") == "P", "altered")
    return t.orders.select("o_orderkey", check.same_state(fp, now, roi, F.lit(None).cast("string"), file).alias("status"))
