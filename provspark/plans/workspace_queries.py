"""Readings of events, lines and parts as the life of workspaces: captured calls, saved states, holders, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provspark.catalog import Tables, query
from provspark.functions import canon, environment, tree
from provspark.operators import check, compare, registry, replay, review, workspace
from provspark.operators.ledger import Ledgers
from provspark.scratch import materialize, scratch_path
from provspark.streaming import observe


@query("select o_custkey as object_uuid from orders union select s_suppkey + 1000000 from supplier union select p_partkey from part where p_size % 2 = 1")
def known_objects(t: Tables) -> DataFrame:
    states = t.orders.select(F.col("o_custkey").alias("object_uuid"))
    return workspace.known_objects(states, t.supplier.select((F.col("s_suppkey") + 1000000).alias("object_uuid")), t.part.where("p_size % 2 = 1").select(F.col("p_partkey").alias("object_uuid")))


@query("select p_partkey as object_uuid, true as fresh, 'appended_without_provenance' as limits from part where p_size % 5 <> 0 and p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')")
def appended_objects(t: Tables) -> DataFrame:
    objects = t.part.select(F.col("p_partkey").alias("object_uuid"), F.when(F.col("p_size") % 5 != 0, "signal").alias("kind"))
    known = workspace.known_objects(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("object_uuid")))
    return workspace.appended(objects, known).select("object_uuid", "fresh", F.array_join("limits", ",").alias("limits"))


def _placed(t: Tables) -> DataFrame:
    """Lines with a position of their own in their order."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select(F.col("l_orderkey").alias("activity_id"), (F.row_number().over(place) - 1).alias("position"), F.col("l_partkey").alias("state_id"), F.col("l_suppkey").alias("object_uuid"), F.col("l_returnflag").alias("flag"))


_PLACED = "l as (select l_orderkey as activity_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as position, l_partkey as state_id, l_suppkey as object_uuid, l_returnflag as flag from lineitem)"


@query(f"""
with {_PLACED}, s as (select p_partkey as state_id, p_partkey % 10 + 1 as object_uuid, p_size as sequence from part),
f as (select l.activity_id, s.object_uuid, arg_min(sequence, position) as sequence from l join s using (state_id) group by 1, 2)
select l.activity_id, l.position, l.object_uuid, case when l.object_uuid % 4 <> 0 and not coalesce(l.object_uuid % 3 = 0 and f.sequence < l.object_uuid * 5, false) then l.object_uuid end as holder
from l left join f on f.activity_id = l.activity_id and f.object_uuid = l.object_uuid where flag = 'R'
""")
def artifact_holders(t: Tables) -> DataFrame:
    lines = _placed(t)
    states = t.part.select(F.col("p_partkey").alias("state_id"), (F.col("p_partkey") % 10 + 1).alias("object_uuid"), F.col("p_size").alias("sequence"))
    keys = t.supplier.select(F.col("s_suppkey").alias("object_uuid"))
    breaks = keys.where("object_uuid % 3 = 0").withColumn("broken_at", F.col("object_uuid") * 5)
    return workspace.artifact_holders(lines.where("flag = 'R'").select("activity_id", "position", "object_uuid"), lines.select("activity_id", "position", "state_id"), states, breaks, keys.where("object_uuid % 4 <> 0"))


@query(f"""
with {_PLACED}, s as (select p_partkey as state_id, p_partkey % 10 + 1 as object_uuid from part),
x as (select o_orderkey as activity_id from orders where o_orderkey not in (select activity_id from l where flag = 'N')),
h as (select activity_id, 0 as side, position, object_uuid from l where flag = 'R' union all select activity_id, 1, position, s.object_uuid from l join s using (state_id)),
f as (select activity_id, object_uuid, min(side * 1000000 + position) as place from h where activity_id in (select activity_id from x) group by 1, 2)
select activity_id, row_number() over (partition by activity_id order by place) - 1 as ord, object_uuid from f
""")
def analysis_holders(t: Tables) -> DataFrame:
    lines = _placed(t)
    outputs = lines.select("activity_id", "position", F.when(F.col("flag") == "N", F.col("state_id")).alias("state_id"), F.when(F.col("flag") == "R", F.struct("object_uuid")).alias("artifact"))
    activities = t.orders.select(F.col("o_orderkey").alias("activity_id"), F.lit("ordinary").alias("origin"))
    states = t.part.select(F.col("p_partkey").alias("state_id"), (F.col("p_partkey") % 10 + 1).alias("object_uuid"))
    found = workspace.analysis_holders(activities, outputs, lines.select("activity_id", "position", "state_id"), states)
    return found.withColumn("ord", F.col("ord").cast("long"))


@query("select event_type as name, count(*) as n, round(median(value), 6) as median, min(value) as least, max(value) as most from events group by event_type")
def call_timings(t: Tables) -> DataFrame:
    return check.timings(t.events, "event_type", "value").withColumnRenamed("event_type", "name").withColumn("median", F.round("median", 6))


@query("select l_partkey as state_id from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'N'")
def shared_states(t: Tables) -> DataFrame:
    of = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("state_id"))
    return check.shared(of("R"), of("N"))


@query("""
with x as (select l_partkey as object_uuid, case when l_suppkey % 2 = 0 then 'signal' else 'image' end as kind, '/' || l_suppkey || '/' || l_linenumber as path from lineitem)
select object_uuid, min(kind) as kind, min(path) as path, count(*) as n, count(*) > 1 as duplicated from x group by object_uuid
""")
def object_index(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_suppkey") % 2 == 0, "signal").otherwise("image")
    return check.object_index(t.lineitem.select(F.col("l_partkey").alias("object_uuid"), kind.alias("kind"), F.concat(F.lit("/"), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("path")))


def _states(t: Tables) -> DataFrame:
    return t.events.select(F.lit("w").alias("workspace_id"), F.col("event_id").alias("state_id"), F.col("user_id").alias("object_uuid"), F.lit("signal").alias("kind"), F.col("event_id").alias("sequence"), F.col("event_id").alias("pos"), F.when(F.col("user_id") % 11 != 0, F.col("event_type")).alias("fp_value"), F.when(F.col("user_id") % 13 == 0, "roi").alias("roi_digest"))


def _saved(t: Tables) -> tuple[DataFrame, DataFrame]:
    """What is saved of each user, and the facts of the saved data."""
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("now"))
    kind = F.when(F.col("user_id") % 17 == 0, "image").otherwise("signal")
    objects = last.where("user_id % 7 <> 0").select(F.col("user_id").alias("object_uuid"), kind.alias("kind"), F.concat(F.lit("/s/"), F.col("user_id").cast("string")).alias("path"))
    now = F.when(F.col("user_id") % 5 == 0, "other").otherwise(F.col("now"))
    return objects, last.where("user_id % 7 <> 0").select(F.col("user_id").alias("object_uuid"), now.alias("fp_value"), F.when(F.col("user_id") % 13 == 0, "roi").alias("roi_digest"))


@query("""
with l as (select user_id as u, max(event_id) as state_id from events group by user_id)
select state_id, 'signal' as kind, '/s/' || u as path from l where u % 7 <> 0 and u % 17 <> 0 and u % 11 <> 0 and u % 5 <> 0
""")
def saved_states(t: Tables) -> DataFrame:
    objects, facts = _saved(t)
    return workspace.saved(Ledgers(None, _states(t), None), objects, facts)


@query("""
with l as (select user_id as u, max(event_id) as last from events group by user_id),
e as (select event_id as state_id, user_id as u, event_type as fp, last, arg_max(event_type, event_id) over (partition by user_id) as now from events join l on u = user_id)
select state_id, u as object_uuid, u % 7 <> 0 as present, state_id = last as latest, case when state_id % 3 = 0 and u % 7 <> 0 then 'unchecked' when u % 7 = 0 then 'absent' when u % 11 = 0 then 'unknown' when state_id % 19 = 0 then 'differs'
  when fp <> (case when u % 5 = 0 then 'other' else now end) then 'differs' else 'matches' end as content, case when state_id % 70 >= 64 then 'depth_limit' else '' end as limits from e
""".replace("arg_max(event_type, event_id) over (partition by user_id)", "first_value(event_type) over (partition by user_id order by event_id desc)"))
def state_descriptions(t: Tables) -> DataFrame:
    objects, facts = _saved(t)
    states = _states(t).withColumn("status", F.when(F.col("state_id") % 19 == 0, "altered")).withColumn("depth", F.col("state_id") % 70)
    found = workspace.descriptions(states, objects, facts, checked=F.col("state_id") % 3 != 0)
    return found.select("state_id", "object_uuid", "present", "latest", "content", F.array_join("limits", ",").alias("limits"))


_USES = """
k as (select user_id % 5 as w, user_id as u, 0 as sequence, 'view' as fp from (select distinct user_id from events where user_id % 4 = 0)),
e as (select user_id % 5 as w, event_id * 2 as ord, event_id as a, 'input' as side, user_id as u, event_type as fp from events
  union all select user_id % 5, event_id * 2 + 1, event_id, 'output', 1000000 + user_id, event_id::varchar from events where event_type = 'purchase'),
b as (select e.*, k.sequence as ks, case when row_number() over z = 1 then k.fp else lag(e.fp) over z end as before, case when row_number() over z = 1 then k.u is not null else true end as had from e left join k on k.w = e.w and k.u = e.u window z as (partition by e.w, e.u order by ord)),
d as (select *, side = 'output' or not had or before is distinct from fp as opened from b),
n as (select w, ord, (select coalesce(max(k.sequence), -1) from k where k.w = d.w) + row_number() over (partition by w order by ord) as sequence from d where opened)
"""


def _uses(t: Tables) -> tuple[DataFrame, DataFrame]:
    known = t.events.where("user_id % 4 = 0").select("user_id").distinct().select((F.col("user_id") % 5).alias("workspace_id"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("state_id"), F.col("user_id").alias("object_uuid"), F.lit("signal").alias("kind"), F.lit("view").alias("fp_value"), F.lit(None).cast("string").alias("roi_digest"), F.lit(0).cast("long").alias("sequence"), F.lit(0).cast("long").alias("pos"))
    use = lambda rows, step, side, role, who, fp: rows.select((F.col("user_id") % 5).alias("workspace_id"), (F.col("event_id") * 2 + step).alias("ord"), F.col("event_id").alias("activity_id"), F.lit(side).alias("side"), F.lit(role).alias("role"), who.alias("object_uuid"), F.lit("signal").alias("kind"), F.lit("s").alias("fp_scheme"), fp.alias("fp_value"), F.lit(None).cast("string").alias("roi_digest"))
    read = use(t.events, 0, "input", "source", F.col("user_id"), F.col("event_type"))
    return known, read.unionByName(use(t.events.where("event_type = 'purchase'"), 1, "output", "result", F.col("user_id") + 1000000, F.col("event_id").cast("string")))


@query(f"with {_USES} select d.w as workspace_id, u as object_uuid, d.ord, fp as fp_value, case when side = 'output' then a end as produced_by, n.sequence from d join n on n.w = d.w and n.ord = d.ord")
def captured_states(t: Tables) -> DataFrame:
    opened, _ = workspace.capture(*_uses(t))
    return opened.select("workspace_id", "object_uuid", "ord", "fp_value", "produced_by", "sequence")


@query(f"""
with {_USES}, j as (select d.*, n.sequence as opened_as from d left join n on n.w = d.w and n.ord = d.ord),
x as (select *, last_value(opened_as ignore nulls) over (partition by w, u order by ord rows between unbounded preceding and current row) as new from j)
select w as workspace_id, a as activity_id, side, case side when 'input' then 'source' else 'result' end as role, ord, coalesce(new, ks) as sequence, case when new is null then 'k' || u end as state_id from x
""")
def captured_calls(t: Tables) -> DataFrame:
    _, bindings = workspace.capture(*_uses(t))
    return bindings


@query("""
with u as (select page_id, page_id // 3 as f, case when page_id % 6 = 5 then 'same' else html end as body from pages where html is not null)
select f as fingerprint, 'n' || page_id as name, octet_length(encode(body)) as size, sha256(body) as sha256, case when page_id % 5 = 0 then 'undeclared' when page_id % 7 = 0 then 'altered' else 'accepted' end as status from u
""")
def attachment_uploads(t: Tables) -> DataFrame:
    return registry.put_attachments(*_uploads(t))[0]


def _uploads(t: Tables) -> tuple[DataFrame, DataFrame]:
    body = F.when(F.col("page_id") % 6 == 5, F.lit("same")).otherwise(F.col("html"))
    each = t.pages.where("html is not null").select("page_id", F.expr("page_id div 3").alias("fingerprint"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("name"), F.encode(body, "UTF-8").alias("content"))
    sha = F.concat(F.lit("sha256:"), F.when(F.col("page_id") % 7 == 0, F.sha2(F.encode("name", "UTF-8"), 256)).otherwise(F.sha2("content", 256)))
    declared = each.where("page_id % 5 <> 0").select("fingerprint", "name", sha.alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    return each.drop("page_id"), declared


@query("""
with u as (select page_id, case when page_id % 6 = 5 then 'same' else html end as body from pages where html is not null), a as (select distinct body from u where page_id % 5 <> 0 and page_id % 7 <> 0)
select page_id as name, sha256(body) as sha256, case when body not in (select body from a) then 'missing' when octet_length(encode(body)) % 4 = 1 then 'damaged' else 'available' end as status from u
""")
def attachment_reads(t: Tables) -> DataFrame:
    uploads, declared = _uploads(t)
    _, blobs = registry.put_attachments(uploads, declared)
    damaged = blobs.withColumn("content", F.when(F.col("size") % 4 == 1, F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("content")))
    stored = uploads.select(F.substring("name", 2, 20).cast("long").alias("name"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    return registry.read_attachments(stored, damaged).select("name", "sha256", "status")


@query("select doc_id as review, case when quality = 0 and toxic = 1 then 'invalid' when doc_id % 6 = 5 then 'tampered' when doc_id % 4 = 3 then 'unknown_target' when doc_id % 10 = 2 then 'known' else 'created' end as status from labels")
def published_reviews(t: Tables) -> DataFrame:
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c.cast("string"), 256))
    reviews = t.labels.select(F.col("doc_id").alias("fingerprint"), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "bad").otherwise(digest(F.col("doc_id"))).alias("target"))
    revisions = t.documents.where("doc_id % 4 <> 3").select(digest(F.col("doc_id")).alias("fingerprint"))
    existing = t.labels.where("doc_id % 10 = 2").select(F.col("doc_id").alias("fingerprint"))
    return registry.publish_reviews(reviews, revisions, existing, F.col("fingerprint") % 6 != 5).select(F.col("fingerprint").alias("review"), "status")


@query("select doc_id as fingerprint, case when doc_id % 5 = 0 then 'missing' when doc_id % 7 = 0 then 'invalid' when doc_id % 3 = 0 then 'another revision' else 'valid' end as status from documents")
def fetched_revisions(t: Tables) -> DataFrame:
    asked = t.documents.select(F.col("doc_id").alias("fingerprint"))
    given = asked.where("fingerprint % 5 <> 0").withColumn("computed", F.when(F.col("fingerprint") % 3 == 0, F.col("fingerprint") + 1).otherwise(F.col("fingerprint")))
    return registry.checked_revisions(asked, given, asked.where("fingerprint % 7 = 0"))


@query("select doc_id, doc_id % 5 not in (1, 2, 3) as sound from documents")
def origin_checks(t: Tables) -> DataFrame:
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("doc_id").cast("string"), 256))
    m = F.col("doc_id") % 5
    record = lambda fp, name, files: F.concat(F.lit('{"fingerprint":'), fp, F.lit(',"name":'), name, F.lit(',"attachments":'), files, F.lit("}"))
    good = canon.json_string(digest)
    text = F.when(m == 1, record(F.lit('"sha256:x"'), F.lit("null"), F.lit("[]"))).when(m == 2, record(good, F.lit("7"), F.lit("[]"))).when(m == 3, record(good, F.lit("null"), F.lit("[1]"))).otherwise(record(good, canon.json_string(F.col("source")), F.lit('["a"]')))
    return t.documents.select("doc_id", environment.origin_sound(text).alias("sound"))


@query("select c_custkey as workspace_id, c_custkey in (select o_custkey from orders) as present from customer")
def blocks_present(t: Tables) -> DataFrame:
    return check.has_block(t.customer.select(F.col("c_custkey").alias("workspace_id")), t.orders.select(F.col("o_custkey").alias("workspace_id")))


@query("""
with e as (select vec_id, label, embedding as v from embeddings), s as (select * from e where label % 2 = 0), m as (select * from e where label % 2 <> 0),
r as (select vec_id, 0 as ord, 'x' as "row", v from s union all select vec_id, 1, 'y', v from s union all select vec_id, 2, 'dx', v from s where vec_id % 3 = 0
  union all select vec_id, 0, 'data', v from m union all select vec_id, 1 + unnest(range(4)), unnest(['x0', 'y0', 'dx', 'dy']), unnest([[vec_id::float], [0], [1], [2]]) from m where vec_id % 2 = 0
  union all select vec_id, 1, 'xcoords', v from m where vec_id % 2 <> 0 union all select vec_id, 2, 'ycoords', v from m where vec_id % 2 <> 0)
select vec_id, ord, "row", len(v) as n, round(list_sum(list_transform(v, lambda x: x::double)), 6) as total from r
""")
def comparison_rows(t: Tables) -> DataFrame:
    wide = F.col("embedding").cast("array<double>")
    nan = F.transform(wide, lambda _: F.lit(float("nan")))
    image, plain = F.col("label") % 2 != 0, F.col("vec_id") % 2 == 0
    one = lambda v: F.lit(float(v)) if not hasattr(v, "cast") else v.cast("double")
    objects = t.embeddings.select(
        "vec_id", F.when(image, "image").otherwise("signal").alias("kind"), wide.alias("x"), wide.alias("y"), F.when(F.col("vec_id") % 3 == 0, wide).alias("dx"), nan.alias("dy"), wide.alias("data"),
        one(F.col("vec_id")).alias("x0"), one(0).alias("y0"), one(1).alias("sx"), one(2).alias("sy"), F.when(image & ~plain, wide).alias("xcoords"), F.when(image & ~plain, wide).alias("ycoords"),
    )
    rows = compare.object_rows(objects, ["vec_id"])
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "ord", "row", F.size("values").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("""
with e as (select vec_id, label % 3 as m from embeddings)
select vec_id, case m when 0 then 'exact' when 1 then 'within_tolerance' else 'different' end as verdict, case m when 0 then 0 else 1 end as mismatches from e
""")
def geometry_artifacts(t: Tables) -> DataFrame:
    wide = F.col("embedding").cast("array<double>")
    first = F.get(wide, F.lit(0))
    moved = F.when(F.col("label") % 3 == 1, first + 1e-9).when(F.col("label") % 3 == 2, first + 1.0).otherwise(first)
    pairs = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 2, F.lit(2)), lambda i: F.array(F.get(v, i), F.get(v, i + 1)))
    ref = t.embeddings.select("vec_id", pairs(wide).alias("coords"))
    cand = t.embeddings.select("vec_id", pairs(F.concat(F.array(moved), F.slice(wide, 2, 1000))).alias("coords"))
    found = compare.compared_rows(compare.geometry_rows(ref, ["vec_id"]), compare.geometry_rows(cand, ["vec_id"]), ["vec_id"], F.lit("tolerance"), atol=1e-6, rtol=0.0)
    return found.select("vec_id", "verdict", F.col("mismatches").cast("int").alias("mismatches"))


@query(f"""
with {_PLACED}, v as (select activity_id, position, case flag when 'N' then 'not_verified' when 'R' then 'within_tolerance' else 'exact' end as verdict, case when flag <> 'N' then 'tolerance' end as rule from l),
w as (select activity_id, arg_max(verdict, list_position(['exact', 'within_tolerance', 'not_verified', 'different'], verdict)) as worst, min(position) filter (where rule is not null) as first from v group by 1)
select o_orderkey as activity_id, case when o_orderstatus = 'P' then 'not_verified' else coalesce(worst, 'not_verified') end as verdict, case when first is not null then 'tolerance' end as rule, first::bigint as mismatches from orders left join w on activity_id = o_orderkey
""")
def report_verdicts(t: Tables) -> DataFrame:
    lines = _placed(t)
    verdict = F.when(F.col("flag") == "N", "not_verified").when(F.col("flag") == "R", "within_tolerance").otherwise("exact")
    outputs = lines.select("activity_id", "position", F.lit("result").alias("role"), verdict.alias("verdict"), F.when(F.col("flag") != "N", "tolerance").alias("rule"), F.col("position").cast("long").alias("mismatches"))
    activities = t.orders.select(F.col("o_orderkey").alias("activity_id"), F.lit("included").alias("restoration"), F.when(F.col("o_orderstatus") == "P", "missing_input").otherwise("ready").alias("eligibility"), F.lit("same").alias("match"))
    return review.build_reports(activities, outputs).select("activity_id", "verdict", "rule", "mismatches")


@query("""
with c as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before, row_number() over (partition by user_id order by event_id) as k from events),
n as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as state_no from c where k = 1 or before <> event_type)
select 'u' || user_id as object_uuid, event_id as ord, event_type as content, state_no from n
""")
def observe_streaming(t: Tables) -> DataFrame:
    """The events as a stream of a few micro-batches in order, observed with kept state."""
    spark, base = t.spark, scratch_path(t.spark, "stream")
    rows = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("object_uuid"), F.col("event_id").alias("ord"), F.col("event_type").alias("content"))
    bounds = rows.agg(F.min("ord"), F.max("ord")).first()
    third = ((bounds[1] or 0) - (bounds[0] or 0)) // 3 + 1
    for k in range(3):  # each third is one micro-batch of many files, oldest first: the stream goes on where it stopped
        low = (bounds[0] or 0) + k * third
        rows.where((F.col("ord") >= low) & (F.col("ord") < low + third)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        found = observe.observe_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
        found.awaitTermination()
    return spark.read.schema(observe.STATES).parquet(f"{base}/out")


@query("select doc_id, n_chars % 9 + 1 as depth, n_chars % 9 + 1 > 6 as refused from documents where n_chars is not null")
def json_depths(t: Tables) -> DataFrame:
    n = (F.col("n_chars") % 9).cast("int")
    text = F.concat(F.repeat(F.lit('{"a":['), F.floor(n / 2).cast("int")), F.when(n % 2 == 0, F.lit('{"x":"[[[["}')).otherwise(F.lit('{"b":["{{"]}')), F.repeat(F.lit("]}"), F.floor(n / 2).cast("int")))
    depth = canon.json_depth(text)
    found = materialize(t.documents.where("n_chars is not null").select("doc_id", depth.alias("depth")), "depths")
    return found.select("doc_id", F.col("depth").cast("long").alias("depth"), (F.col("depth") > 6).alias("refused"))


@query("""
select l_partkey as object_uuid, case when count(*) % 7 = 3 then null else '{"indices":[' || string_agg(l_suppkey::varchar, ',' order by k) || '],"kind":"rect","n":' || count(*) || '}' end as json,
  case when count(*) % 7 = 3 then 'no item ' || (count(*) - 1) || ': indices' end as problem
from (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 as k from lineitem) group by l_partkey
""")
def stored_trees(t: Tables) -> DataFrame:
    """Regions of interest as they are stored: a dictionary with a sequence of datasets, some without their last item."""
    place = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    lines = t.lineitem.select(F.col("l_partkey").alias("object_uuid"), "l_suppkey", (F.row_number().over(place) - 1).alias("k"))
    sizes = lines.groupBy("object_uuid").agg(F.count("*").alias("n"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    node = lambda rows, path, attributes, data: rows.select("object_uuid", path.alias("path"), attributes.alias("attributes"), data.alias("data"))
    none = F.lit(None).cast("string")
    roots = node(sizes, F.lit(""), text('{"__dict":true,"kind":"rect","n":', F.col("n"), "}"), none)
    lists = node(sizes, F.lit("indices"), text('{"__seq":', F.col("n"), "}"), none)
    whole = lines.join(sizes, "object_uuid").where("not (n % 7 = 3 and k = n - 1)")
    return tree.decoded(roots.unionByName(lists).unionByName(node(whole, text("indices/__seq", F.col("k")), none, F.col("l_suppkey").cast("string"))), ["object_uuid"])


@query("select o_orderkey, case o_orderstatus when 'P' then case when o_custkey % 3 = 0 then 'unsupported_context' when o_custkey % 3 = 1 then 'invalid_parameters' end when 'F' then 'unsupported_operation' end as refusal from orders")
def error_codes(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "execution").when(F.col("o_orderstatus") == "F", "unknown_operation").otherwise("other")
    code = F.when(F.col("o_custkey") % 3 == 0, "input_mismatch").when(F.col("o_custkey") % 3 == 1, "invalid_parameters").otherwise("crashed")
    return t.orders.select("o_orderkey", replay.refusal_of_error(kind, code).alias("refusal"))
