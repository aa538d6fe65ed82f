"""Readings of orders as whole documents of the model: ledgers, manifests, capsules, reviews, reports.

A customer is a workspace, an order a state, in order of its key. An order that is not open is also the result of an
activity on the one or two orders before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.catalog import Tables, query
from provspark.functions import canon
from provspark.operators import ledger, manifest, review
from provspark.plans import build, verify
from provspark.scratch import materialize
from provspark.sources import capsule

_PROFILE = "https://example.org/profile/0.1"
_WORDS = build.Vocabulary(_PROFILE, "profile", "0.1", "https://example.org/terms#", "workspace", editions={"desktop": "Desk"})
_TERMS = (
    "CreateAction UpdateAction CreativeWork Dataset File PropertyValue SoftwareApplication about conformsTo hasPart mentions name description datePublished license sha256 contentSize "
    "encodingFormat instrument object result position value softwareVersion actionStatus identifier softwareRequirements isPartOf startTime endTime version"
).split()

#: The orders, numbered in their workspace: k from 0, the two before, and whether an activity made it.
_ORDERS = """
o as (select o_custkey as w, o_orderkey as s, o_orderstatus as status, o_orderpriority as priority, o_totalprice as price, row_number() over z - 1 as k, lag(o_orderkey) over z as p1, lag(o_orderkey, 2) over z as p2 from orders window z as (partition by o_custkey order by o_orderkey)),
a as (select *, 'lib.p' || substr(priority, 1, 1) as op from o where status <> 'O' and k > 0),
i as (select w, s, 0 as position, 'source' as role, p1 as b from a union all select w, s, 1, 'operand', p2 from a where p2 is not null)
"""


def _uuid(number: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def _u(name: str) -> str:
    return f"'00000000-0000-4000-8000-' || lpad(({name})::varchar, 12, '0')"


def _numbered(t: Tables) -> DataFrame:
    z = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("w"), F.col("o_orderkey").alias("s"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.row_number().over(z) - 1).alias("k"), F.lag("o_orderkey").over(z).alias("p1"), F.lag("o_orderkey", 2).over(z).alias("p2"))
    return rows.withColumn("made", (F.col("status") != "O") & (F.col("k") > 0))


def _environment() -> tuple[Column, Column]:
    """The canonical record of a workspace's environment, and its identifier."""
    record = canon.flat_json({"edition": F.lit('"desktop"'), "edition_version": canon.json_string(F.concat(F.lit("1."), (F.col("w") % 3).cast("string"))), "packages": F.lit('{"h5":null,"np":"2.3.0"}')})
    return record, canon.binary_digest(F.encode(record, "UTF-8"))


def _texts(t: Tables, broken: bool = False) -> DataFrame:
    """``(w, text)``: each customer's ledger as JSON; ``broken`` plants faults by order key."""
    rows = _numbered(t)
    record, home = _environment()
    sid = lambda c: _uuid(F.col(c))
    fault = F.col("s") % 11 if broken else F.lit(-1)
    state = F.struct(sid("s").alias("state_id"), _uuid(F.col("s") % 97).alias("object_uuid"), F.lit("signal").alias("kind"), F.struct(F.lit("s/1").alias("scheme"), canon.binary_digest(F.encode(F.col("s").cast("string"), "UTF-8")).alias("value")).alias("fingerprint"), F.lit("float64").alias("dtype"), F.lit(4).alias("length"), F.when(F.col("made"), _uuid(F.col("s") + 500_000_000)).alias("produced_by"), F.col("k").alias("sequence"))
    bind = lambda role, s: F.struct(F.lit(role).alias("role"), F.struct(s.alias("state_id")).alias("binding"))
    first = bind("source", F.when(fault == 1, F.lit("nowhere")).otherwise(sid("p1")))
    first = F.when(fault == 2, bind("", sid("p1"))).otherwise(first)
    inputs = F.array_compact(F.array(first, F.when(F.col("p2").isNotNull(), bind("operand", sid("p2")))))
    operation = F.struct(F.when(fault == 3, F.lit("Bad Op")).otherwise(F.concat(F.lit("lib.p"), F.substring("priority", 1, 1))).alias("id"), F.when(fault == 4, 0).otherwise(1).alias("contract_version"))
    call = F.struct(operation.alias("operation"), F.struct(F.col("k").alias("n"), F.col("priority").alias("p")).alias("parameters"), inputs.alias("inputs"))
    activity = F.struct(
        _uuid(F.col("s") + 500_000_000).alias("activity_id"), _uuid(F.col("w")).alias("command_id"), call.alias("call"), F.array(F.struct(F.lit("result").alias("role"), sid("s").alias("state_id"))).alias("outputs"),
        F.array(F.col("status")).alias("limits"), F.when(fault == 5, F.lit("sha256:x")).otherwise(home).alias("environment_id"), F.lit("desktop").alias("edition"), F.lit("ordinary").alias("origin"), F.lit("completed").alias("status"),
    )
    each = rows.select("w", F.struct("s", F.concat(canon.json_string(sid("s")), F.lit(":"), F.to_json(state)).alias("j")).alias("st"), F.when(F.col("made"), F.struct("s", F.to_json(activity).alias("j"))).alias("ac"))
    joined = each.groupBy("w").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["j"]), ",").alias(c) for c in ("st", "ac")])
    text = F.concat(F.lit('{"workspace_id":"'), F.col("w").cast("string"), F.lit('","environments":{'), canon.json_string(home), F.lit(":"), record, F.lit('},"states":{'), F.col("st"), F.lit('},"activities":['), F.col("ac"), F.lit("]}"))
    return joined.select("w", text.alias("text"))


def _ledgers(t: Tables, broken: bool = False) -> ledger.Ledgers:
    return ledger.from_json(materialize(_texts(t, broken), "ledgers"))  # each table of the ledgers reads the texts


@query(f"""
with {_ORDERS}, n as (select w, count(*) as states, max(k) as last_sequence from o group by w), m as (select w, count(*) as activities from a group by w), b as (select w, count(*) as inputs from i group by w)
select n.w::varchar as workspace_id, states, last_sequence, coalesce(activities, 0) as activities, coalesce(inputs, 0) as inputs, coalesce(activities, 0) as outputs, 1 as environments from n left join m using (w) left join b using (w)
""")
def ledger_tables(t: Tables) -> DataFrame:
    found = _ledgers(t)
    count = lambda df, name: df.groupBy("workspace_id").agg(F.count("*").alias(name))
    out = found.states.groupBy("workspace_id").agg(F.count("*").alias("states"), F.max("sequence").alias("last_sequence"))
    for df, name in ((found.activities, "activities"), (found.inputs, "inputs"), (found.outputs, "outputs"), (found.environments, "environments")):
        out = out.join(count(df, name), "workspace_id", "left")
    return out.na.fill(0).withColumn("environments", F.col("environments").cast("int"))


@query(f"with {_ORDERS} select w::varchar as workspace_id, {_u('s + 500000000')} as activity_id, position, role, {_u('b')} as state_id, op, status as limit_code, 'sha256:' || sha256('{{\"edition\":\"desktop\",\"edition_version\":\"1.' || (w % 3) || '\",\"packages\":{{\"h5\":null,\"np\":\"2.3.0\"}}}}') as environment_id from i join a using (w, s)")
def ledger_round_trip(t: Tables) -> DataFrame:
    found = _ledgers(t)
    for _ in range(2):
        found = ledger.from_json(materialize(ledger.to_json(found), "ledgers"))
    homes = found.environments.where(canon.canonical_digest(F.col("record_json")) == F.col("environment_id")).select("workspace_id", "environment_id")
    acts = found.activities.join(homes, ["workspace_id", "environment_id"]).select("workspace_id", "activity_id", F.col("call.operation.id").alias("op"), F.get("limits", F.lit(0)).alias("limit_code"), "environment_id")
    return found.inputs.select("workspace_id", "activity_id", "position", "role", "state_id").join(acts, ["workspace_id", "activity_id"])


@query(f"""
with {_ORDERS}, f as (select w, s, {_u('s + 500000000')} as subject, s % 11 as fault from a)
select w::varchar as workspace_id, subject, case fault when 1 then 'unknown input state' when 2 then 'a role is a non-empty text' when 3 then 'invalid operation identifier' when 4 then 'contract_version is an integer of 1 or more' else 'unknown environment' end as problem from f where fault between 1 and 5
""")
def ledger_problems(t: Tables) -> DataFrame:
    return ledger.validate(_ledgers(t, broken=True))


def _roots(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").cast("string").alias("workspace_id")).distinct().select(
        "workspace_id", F.concat(F.lit("work "), F.col("workspace_id")).alias("name"), F.lit("orders").alias("description"), F.lit("CC0").alias("license"), F.lit("2026-01-01").alias("published"), F.lit(None).cast("string").alias("revision_of"), F.lit(None).cast("string").alias("workspace_ref"),
        F.concat(F.lit("sha256:"), F.sha2(F.encode(F.concat(F.lit("bytes "), F.col("workspace_id")), "UTF-8"), 256)).alias("workspace_sha256"), (F.length("workspace_id") + 6).cast("long").alias("workspace_size"),
    )


def _files(t: Tables) -> DataFrame:
    """Two attachments a workspace, as declared."""
    each = t.orders.select(F.col("o_custkey").cast("string").alias("workspace_id")).distinct().withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    body = F.concat(F.lit("note "), F.col("ord").cast("string"), F.lit(" of "), F.col("workspace_id"))
    return each.select("workspace_id", "ord", F.concat(F.lit("note"), F.col("ord").cast("string"), F.lit(".txt")).alias("name"), F.lit("text/plain").alias("media_type"), F.octet_length(body).cast("long").alias("size"), F.concat(F.lit("sha256:"), F.sha2(F.encode(body, "UTF-8"), 256)).alias("sha256"), F.lit("").alias("description"), body.alias("body"))


def _manifests(t: Tables) -> DataFrame:
    """``(workspace_id, fingerprint, text)``, a table: texts are read several times."""
    locators = _numbered(t).where("k % 2 = 0").select(_uuid(F.col("s")).alias("state_id"), F.lit("signal").alias("kind"), F.concat(F.lit("/signals/g/"), F.col("s").cast("string")).alias("path"))
    return materialize(build.build(_ledgers(t), locators, _roots(t), _WORDS, _files(t).drop("body")), "manifests")


def _named(made: DataFrame) -> DataFrame:
    return made.select(F.col("workspace_id").alias("manifest"), "text")


_LISTED = "string_agg({0}, ',' order by position)"


@query(f"""
with {_ORDERS}, b as (select w, s, string_agg(role || '>#state-' || {_u('b')}, ',' order by position) as inputs from i group by w, s),
e as (select *, row_number() over (partition by w order by s) - 1 as ord from a)
select e.w::varchar as manifest, ord, '#activity-' || {_u('e.s + 500000000')} as id, 'CreateAction' as type, op as name, true as replayable, op || ',Desk' as instruments, 'ordinary' as origin, inputs,
  'result>#state-' || {_u('e.s')} as outputs, status as limits, '{{n=' || k || ', p="' || priority || '"}}' as parameters from e join b using (w, s)
""")
def manifest_activities(t: Tables) -> DataFrame:
    found = manifest.inspect(_named(_manifests(t)))
    bound = lambda c: F.array_join(F.transform(c, lambda i: F.concat(i["role"], F.lit(">"), i["target"])), ",").alias(c)
    given = found.parameters.groupBy("manifest", "id").agg(F.sort_array(F.collect_list(F.struct("position", F.concat("name", F.lit("="), "json").alias("x")))).alias("x"))
    shown = F.concat(F.lit("{"), F.array_join(F.transform("x", lambda p: p["x"]), ", "), F.lit("}"))
    acts = found.activities.join(given, ["manifest", "id"])
    return acts.select("manifest", F.col("ord").cast("long").alias("ord"), "id", "type", "name", "replayable", F.array_join("instruments", ",").alias("instruments"), "origin", bound("inputs"), bound("outputs"), F.array_join("limits", ",").alias("limits"), shown.alias("parameters"))


@query(f"""
with {_ORDERS}, c as (select w, b, string_agg('#activity-' || {_u('s + 500000000')}, ',' order by s, position) as consumed_by, count(*) as n from i group by w, b)
select o.w::varchar as manifest, '#state-' || {_u('o.s')} as id, 'signal' as kind, {_u('o.s % 97')} as object_uuid, 'sha256:' || sha256(o.s::varchar) as fingerprint, case when o.k % 2 = 0 then '/signals/g/' || o.s end as locator,
  case when a.s is not null then '#activity-' || {_u('a.s + 500000000')} end as produced_by, coalesce(consumed_by, '') as consumed_by, coalesce(n, 0) > 1 as fans_out from o left join a using (w, s) left join c on c.w = o.w and c.b = o.s
""")
def manifest_states(t: Tables) -> DataFrame:
    found = manifest.inspect(_named(_manifests(t)))
    return found.states.select("manifest", "id", "kind", "object_uuid", "fingerprint", "locator", "produced_by", F.array_join("consumed_by", ",").alias("consumed_by"), manifest.fans_out(F.col("consumed_by")).alias("fans_out"))


@query("""
with c as (select distinct o_custkey as w from orders), n as (select unnest([0, 1]) as k)
select w::varchar as manifest, 'work ' || w as name, 'orders' as description, 'CC0' as license, '2026-01-01' as date_published, 'workspace.h5' as workspace, false as workspace_referenced, sha256('bytes ' || w) as workspace_sha256, (6 + length(w::varchar))::varchar as workspace_size,
  'note0.txt:' || sha256('note 0 of ' || w) || ',note1.txt:' || sha256('note 1 of ' || w) as attachments, true as signed from c
""")
def manifest_roots(t: Tables) -> DataFrame:
    made = _manifests(t)
    found = manifest.inspect(_named(made))
    files = found.attachments.groupBy("manifest").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("name", F.lit(":"), "sha256").alias("x")))), lambda f: f["x"]), ",").alias("attachments"))
    own = made.select(F.col("workspace_id").alias("manifest"), F.col("fingerprint").alias("_fp"))
    return found.roots.join(files, "manifest").join(own, "manifest").select("manifest", "name", "description", "license", "date_published", "workspace", "workspace_referenced", "workspace_sha256", "workspace_size", "attachments", (F.col("fingerprint") == F.col("_fp")).alias("signed"))


#: What is done to the texts of manifests, by customer key modulo 9, and the problems that must be found, the fingerprint aside.
_FAULTS = (
    (1, '"license":"CC0"', '"license":""', "./", "root has no text as license"),
    (2, '"@id":"https://w3id.org/ro/wfrun/process/0.6"', '"@id":"https://example.org/other"', "./", "root does not conform to https://w3id.org/ro/wfrun/process/0.6"),
    (3, '"name":"note0.txt"', '"name":"other.txt"', "attachments/note0.txt", "attachment name is not its file name"),
    (4, '"dlc:attachment":true', '"dlc:attachment":"yes"', None, "attachment is no File marked true"),
    (5, '"about":{"@id":"./"}', '"about":{"@id":"#x"}', "./", "descriptor is not about ./"),
    (6, '"@type":"Dataset"', '"@type":"Thing"', "./", "root is no Dataset"),
    (7, '"sha256":"', '"sha256":"z', "workspace.h5", "workspace without sha256"),
)


@query(
    "with c as (select distinct o_custkey as w from orders) "
    + " union all ".join(f"select w::varchar as workspace_id, '{problem}' as problem, 1 as n from c where w % 9 = {m}" for m, _, _, subject, problem in _FAULTS if m not in (4, 7))
    + " union all select w::varchar, 'attachment is no File marked true', 2 from c where w % 9 = 4 union all select w::varchar, 'workspace without sha256', 1 from c where w % 9 = 7 union all select w::varchar, 'invalid attachment digest', 2 from c where w % 9 = 7"
    + " union all select w::varchar, 'dangling reference #x', 1 from c where w % 9 = 5 union all select w::varchar, 'undefined type', 1 from c where w % 9 = 6"
    + " union all select w::varchar, 'fingerprint does not match', 1 from c where w % 9 between 1 and 7"
)
def manifest_problems(t: Tables) -> DataFrame:
    text = F.col("text")
    for m, old, new, _, _ in _FAULTS:
        text = F.when(F.col("workspace_id").cast("long") % 9 == m, F.replace(F.col("text"), F.lit(old), F.lit(new))).otherwise(text)
    found = manifest.validate(_named(_manifests(t).withColumn("text", text)), _PROFILE, _TERMS)
    return found.groupBy(F.col("manifest").alias("workspace_id"), "problem").agg(F.count("*").cast("int").alias("n"))


@query("select distinct o_custkey::varchar as workspace_id, o_custkey % 5 <> 2 as described from orders")
def rebuilt_manifests(t: Tables) -> DataFrame:
    made = _manifests(t).select("workspace_id", "fingerprint")
    stored = made.withColumn("fingerprint", F.when(F.col("workspace_id").cast("long") % 5 == 2, F.concat(F.lit("sha256:"), F.sha2("fingerprint", 256))).otherwise(F.col("fingerprint")))
    return verify.rebuilt(stored, made)


def _capsules(t: Tables, tampered: bool = False) -> DataFrame:
    """``(capsule, content)`` of every customer; ``tampered`` changes bytes, drops or adds files by customer key."""
    m = F.col("capsule").cast("long") % 7 if tampered else F.lit(-1)
    own = _manifests(t).select(F.col("workspace_id").alias("capsule"), F.lit("ro-crate-metadata.json").alias("name"), F.encode("text", "UTF-8").alias("content"))
    work = _roots(t).select(F.col("workspace_id").alias("capsule"), F.lit("workspace.h5").alias("name"), F.encode(F.concat(F.lit("bytes "), F.col("workspace_id")), "UTF-8").alias("content"))
    work = work.withColumn("content", F.when(m == 1, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("content")))
    files = _files(t).select(F.col("workspace_id").alias("capsule"), F.concat(F.lit("attachments/"), F.col("name")).alias("name"), F.encode("body", "UTF-8").alias("content"))
    files = files.where(~((m == 2) & F.col("name").endswith("1.txt"))).withColumn("name", F.when((m == 3) & F.col("name").endswith("0.txt"), "attachments/more.txt").otherwise(F.col("name")))
    return capsule.create(own.unionByName(work).unionByName(files)).select("capsule", "content")


@query("""
with c as (select distinct o_custkey::varchar as w from orders), e as (select w as capsule, 1 as ord, 'workspace.h5' as name, 'bytes ' || w as body from c union all select w, 2 + k, 'attachments/note' || k || '.txt', 'note ' || k || ' of ' || w from c, (select unnest([0, 1]) as k))
select capsule, ord, name, octet_length(encode(body)) as size, sha256(body) as sha256, false as compressed, null::varchar as refusal from e
""")
def capsule_entries(t: Tables) -> DataFrame:
    entries = capsule.entries_of(_capsules(t), contents=True)
    return entries.where("name <> 'ro-crate-metadata.json'").select("capsule", "ord", "name", "size", "sha256", "compressed", "refusal")


@query("""
with c as (select distinct o_custkey as w from orders)
select w::varchar as capsule, w % 7 not in (1, 2, 3) as valid, 'integrity_only' as workspace, case w % 7 when 1 then 1 when 2 then 1 when 3 then 2 else 0 end as problems from c
""")
def capsule_verdicts(t: Tables) -> DataFrame:
    verdicts, _ = verify.verify_entries(materialize(capsule.entries_of(_capsules(t, tampered=True)), "entries"), _PROFILE, _TERMS)
    return verdicts.select("capsule", "valid", "workspace", F.col("problems").cast("int").alias("problems"))


@query("with c as (select distinct o_custkey::varchar as w from orders) select w as capsule, 'bytes ' || w as workspace, 'work ' || w as name, 'note0.txt,note1.txt' as attachments, 'note 0 of ' || w as note from c")
def opened_capsules(t: Tables) -> DataFrame:
    entries = materialize(capsule.entries_of(_capsules(t), contents=True), "entries")
    origin = F.from_json("origin", "fingerprint string, name string, attachments array<string>")
    opened = capsule.opened(entries).select("capsule", F.decode("content", "UTF-8").alias("workspace"), origin["name"].alias("name"), F.array_join(origin["attachments"], ",").alias("attachments"))
    return opened.join(capsule.attachment(entries, "note0.txt").select("capsule", F.decode("content", "UTF-8").alias("note")), "capsule")


@query("""
with c as (select distinct o_custkey as w from orders), k as (select unnest(range(6)) as i),
r as (select w, i from c, k)
select w::varchar as capsule, case when i < 4 then 'review' else 'report' end as kind, i as index,
  case when i = 0 then 'valid' when i = 1 then 'fingerprint does not match' when i = 2 then 'another revision' when i = 3 then 'cites an activity the capsule has not' when i = 4 then 'cites an activity the capsule has not' else 'unknown verdict' end as status from r
""")
def supplied_documents(t: Tables) -> DataFrame:
    entries = materialize(capsule.entries_of(_capsules(t)), "entries")
    roots = materialize(manifest.outline(capsule.manifests(entries)).select(F.col("manifest").alias("capsule"), F.explode("roots.fingerprint").alias("fp")), "roots")
    each = roots.withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(5))))
    target = F.when(F.col("index") == 2, F.concat(F.lit("sha256:"), F.sha2("fp", 256))).otherwise(F.col("fp"))
    cited = F.when(F.col("index") == 3, F.array(F.struct(F.lit("nowhere").alias("activity_id"), F.lit("exact").alias("verdict")))).otherwise(F.array().cast("array<struct<activity_id:string,verdict:string>>"))
    body = review.review_json("review", target, F.lit("me"), F.lit(None).cast("string"), F.lit("2026-01-01"), F.lit("fine"), F.lit(None).cast("string"), cited)
    signed = each.withColumn("_b", body).withColumn("_fp", review.signed(F.col("_b")))
    own = F.when(F.col("index") == 1, F.concat(F.lit("sha256:"), F.sha2("_fp", 256))).otherwise(F.col("_fp"))
    text = F.concat(F.expr("substring(_b, 1, length(_b) - 1)"), F.lit(',"review_fingerprint":'), canon.json_string(own), F.lit("}"))
    report = F.concat(F.lit('{"activity_id":"nowhere","restoration":"included","eligibility":"ready","inputs":[],"environment":{"match":"same"},"outputs":[],"verdict":'), F.when(F.col("index") == 5, F.lit('"probably"')).otherwise(F.lit('"not_verified"')), F.lit("}"))
    documents = signed.select("capsule", F.when(F.col("index") < 4, "review").otherwise("report").alias("kind"), "index", F.when(F.col("index") < 4, text).otherwise(report).alias("text"))
    return verify.inspect_entries(entries, _PROFILE, _TERMS, documents)[2]
