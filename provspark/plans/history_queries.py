"""Readings of events, orders and lines as objects, states and activities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.catalog import Tables, query
from provspark.operators import check, graph, history, workspace


def _user_events(t: Tables) -> DataFrame:
    """Events as observations of the object ``user_id``; event_id is the order of recording."""
    return t.events.select("user_id", "event_id", "event_type", "value")


OBSERVE = """
select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as state_no
from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before,
  row_number() over (partition by user_id order by event_id) as n from events)
where n = 1 or event_type is distinct from before
"""


@query(OBSERVE)
def observe_states(t: Tables) -> DataFrame:
    return history.observe(_user_events(t).drop("value"), "user_id", ["event_id"], ["event_type"])


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def latest_state(t: Tables) -> DataFrame:
    return history.latest(_user_events(t), "user_id", ["event_id"])


@query("select coalesce(max(event_id), -1) + 1 as next_sequence from events")
def next_sequence(t: Tables) -> DataFrame:
    return history.next_sequence(t.events.select(F.col("event_id").alias("sequence"), F.col("event_id").alias("pos")))


def _states(t: Tables) -> DataFrame:
    """Each user's latest event as its state; the event type is the fingerprint."""
    rows = history.latest(_user_events(t), "user_id", ["event_id"])
    return rows.select(F.col("event_id").alias("state_id"), F.col("user_id").alias("object_uuid"), F.lit("signal").alias("kind"), F.col("event_type").alias("fp_value"), F.lit(None).cast("string").alias("roi_digest"))


def _saved(t: Tables) -> DataFrame:
    """What is saved of two users in three: the state before the last ten percent of events."""
    last = t.events.agg((F.max("event_id") * 9 / 10).cast("long")).scalar()
    older = history.latest(_user_events(t).where(F.col("event_id") <= last), "user_id", ["event_id"])
    return older.where("user_id % 3 <> 0").select(F.col("user_id").alias("object_uuid"), F.lit("signal").alias("kind"), F.concat(F.lit("/signals/g/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("fp_value"), F.lit(None).cast("string").alias("roi_digest"))


@query("""
with cut as (select max(event_id) as m from events),
now as (select user_id, max(event_id) as state_id, arg_max(event_type, event_id) as fp from events group by user_id),
saved as (select user_id, arg_max(event_type, event_id) as fp from events, cut where event_id <= m * 9 // 10 and user_id % 3 <> 0 group by user_id)
select n.state_id, n.user_id as object_uuid, case when s.user_id is null then 'unavailable' when s.fp is distinct from n.fp then 'altered' end as status
from now n left join saved s using (user_id)
""")
def state_status(t: Tables) -> DataFrame:
    states, saved = _states(t), _saved(t)
    places = check.located(states, saved)
    bad = check.altered(states.join(places.select("state_id"), "state_id"), saved)
    return check.file_status(states, places, bad).select("state_id", "object_uuid", "status")


@query("""
select user_id, event_id, rank, n > 20 as truncated from
(select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as rank, count(*) over (partition by user_id) as n from events) where rank <= 20
""")
def object_states_top20(t: Tables) -> DataFrame:
    return history.last_of_each(t.events.select("user_id", "event_id"), "user_id", ["event_id"], 20, "truncated")


@query("""
select user_id, event_id, value, rank, n > 50 as analyses_truncated from
(select user_id, event_id, value, row_number() over (partition by user_id order by event_id desc) as rank, count(*) over (partition by user_id) as n from events where event_type = 'purchase') where rank <= 50
""")
def analyses_top50(t: Tables) -> DataFrame:
    return history.last_of_each(t.events.where("event_type = 'purchase'").select("user_id", "event_id", "value"), "user_id", ["event_id"], 50, "analyses_truncated")


@query("""
select l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, position, input_count, input_count > 200 as inputs_truncated from
(select l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 as position, count(*) over (partition by l_partkey) as input_count from lineitem) where position < 200
""")
def inputs_first200(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return history.first_of_each(rows, "l_partkey", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], 200, "input_count", "inputs_truncated")


@query("select l_orderkey as command_id, string_agg(l_linenumber::varchar || ':' || l_partkey::varchar, ',' order by l_linenumber, l_partkey) as activities from lineitem group by l_orderkey")
def commands(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("command_id"), "l_linenumber", "l_partkey")
    listed = history.grouped(rows, "command_id", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"], "items")
    return listed.select("command_id", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("activities"))


def _inputs(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("state_id"), F.col("l_orderkey").alias("activity_id"))


@query("select p_partkey as state_id, count(l_orderkey) as consumers from part left join lineitem on l_partkey = p_partkey group by p_partkey")
def consumers(t: Tables) -> DataFrame:
    return graph.consumers(t.part.select(F.col("p_partkey").alias("state_id")), _inputs(t))


@query("select l_partkey as state_id, count(*) as consumers from lineitem group by l_partkey having count(*) > 1")
def consumers_fanout(t: Tables) -> DataFrame:
    return graph.fan_out(_inputs(t))


@query("""
select p_partkey as state_id, max(l_orderkey) as producer from part left join lineitem on l_partkey = p_partkey and l_returnflag = 'R' group by p_partkey
""")
def produced_by(t: Tables) -> DataFrame:
    made = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("state_id")).agg(F.max("l_orderkey").alias("activity_id"))
    return graph.produced_by(t.part.select(F.col("p_partkey").alias("state_id")), made)


def _family(t: Tables) -> DataFrame:
    """Edges child -> parent: order, customer, nation, region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t.orders.select(name("o", "o_orderkey").alias("child"), name("c", "o_custkey").alias("parent"))
        .unionByName(t.customer.select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")))
        .unionByName(t.nation.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
    )


@query("""
with recursive edges as (
  select 'o' || o_orderkey as child, 'c' || o_custkey as parent from orders
  union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation),
walk as (select 'o' || o_orderkey as start, 'o' || o_orderkey as node, 0 as depth from orders
  union all select start, parent, depth + 1 from walk join edges on child = node where depth < 64)
select start, node, min(depth) as depth from walk group by start, node
""")
def lineage_closure(t: Tables) -> DataFrame:
    return graph.ancestries(_family(t), t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node")))


@query("""
with recursive walk as (select doc_id as start, doc_id as node, 0 as depth from documents
  union all select start, node // 2, depth + 1 from walk where node > 0 and depth < 64 and (node // 2) in (select doc_id from documents))
select start, node, min(depth) as depth from walk group by start, node
""")
def revision_chain(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id").where("doc_id is not null")
    parents = ids.select(F.col("doc_id").alias("fingerprint"), F.when(F.col("doc_id") > 0, F.expr("doc_id div 2")).alias("revision_of"))
    known = parents.join(ids.select(F.col("doc_id").alias("revision_of")), "revision_of").unionByName(parents.where("revision_of is null").select("revision_of", "fingerprint"))
    return graph.chain(known)


@query("""
with b as (select user_id, max(event_id) as broken_at from events where event_type = 'signup' group by user_id)
select e.user_id, event_id, event_type, broken_at, case when broken_at is null or event_id >= broken_at then e.user_id end as holder from events e left join b using (user_id)
""")
def identity_break(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type")
    breaks = history.last_break(rows, "user_id", "event_id", F.col("event_type") == "signup")
    held = history.holder(rows, breaks, "user_id", "event_id", rows)
    return held.join(breaks, "user_id", "left").select("user_id", "event_id", "event_type", "broken_at", "holder")


@query("""
with b as (select user_id, max(event_id) as broken_at from events where event_type = 'signup' group by user_id)
select e.user_id, count(*) as kept from events e left join b using (user_id) where broken_at is null or event_id >= broken_at group by e.user_id
""")
def records_since_break(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type")
    breaks = history.last_break(rows, "user_id", "event_id", F.col("event_type") == "signup")
    return history.since_break(rows, breaks, "user_id", "event_id").groupBy("user_id").agg(F.count("*").alias("kept"))


@query("""
with s as (select user_id, event_id, event_type, coalesce(event_type is distinct from lag(event_type) over w, true) as opened from events window w as (partition by user_id order by event_id)),
n as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as state_no, row_number() over (partition by user_id order by event_id desc) as back, count(*) over (partition by user_id) as states from s where opened),
l as (select user_id, event_id as latest, event_type as content, states from n where back = 1),
a as (select user_id, count(*) as analyses from events where event_type = 'purchase' group by user_id)
select l.user_id, latest, content, states, states > 20 as states_truncated, coalesce(analyses, 0) as analyses from l left join a using (user_id)
""")
def describe_object(t: Tables) -> DataFrame:
    opened = history.observe(t.events.select("user_id", "event_id", "event_type"), "user_id", ["event_id"], ["event_type"])
    return workspace.object_summaries(opened, t.events.where("event_type = 'purchase'"), "user_id", "event_id", "event_type")


@query("""
with p as (select l_partkey, max(l_orderkey) as o from lineitem where l_returnflag <> 'N' group by l_partkey)
select p_partkey as state_id, o as activity_id, o_custkey as command_id, string_agg(i.l_partkey::varchar, ',' order by i.l_linenumber, i.l_partkey) as inputs
from part left join p on p.l_partkey = p_partkey left join orders on o_orderkey = o left join lineitem i on i.l_orderkey = o group by all
""")
def producing_call(t: Tables) -> DataFrame:
    made = t.lineitem.where("l_returnflag <> 'N'").groupBy(F.col("l_partkey").alias("state_id")).agg(F.max("l_orderkey").alias("activity_id"))
    states = graph.produced_by(t.part.select(F.col("p_partkey").alias("state_id")), made).withColumnRenamed("producer", "activity_id")
    calls = history.grouped(t.lineitem.select(F.col("l_orderkey").alias("activity_id"), "l_linenumber", "l_partkey"), "activity_id", ["l_linenumber", "l_partkey"], ["l_partkey"], "items")
    orders = t.orders.select(F.col("o_orderkey").alias("activity_id"), F.col("o_custkey").alias("command_id"))
    joined = states.join(orders, "activity_id", "left").join(calls, "activity_id", "left")
    return joined.select("state_id", "activity_id", "command_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("inputs"))


@query("""
select o_orderkey as activity_id, o_custkey as command_id, count(l_orderkey) as input_count, least(count(l_orderkey), 200) as inputs_shown, count(l_orderkey) > 200 as inputs_truncated,
  case when o_orderstatus = 'P' then 'opaque' when o_custkey % 10 = 0 then 'unknown' when o_orderstatus = 'O' then 'incompatible' else 'known' end as support
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderstatus
""")
def describe_activity(t: Tables) -> DataFrame:
    support = workspace.support(F.col("o_orderstatus") == "P", F.col("o_custkey") % 10 != 0, F.col("o_orderstatus") != "O")
    activities = t.orders.select(F.col("o_orderkey").alias("activity_id"), F.col("o_custkey").alias("command_id"), support.alias("support"))
    return workspace.activity_summaries(activities, t.lineitem.select(F.col("l_orderkey").alias("activity_id")))
