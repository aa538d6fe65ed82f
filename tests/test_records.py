"""Ledgers, manifests, capsules, comparison, lineage and streams against hand-made cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.functions import canon
from provspark.operators import check, compare, graph, history, ledger, legacy, manifest, registry
from provspark.plans import verify
from provspark.sources import capsule
from provspark.streaming import observe

U = "00000000-0000-4000-8000-{:012d}".format
PROFILE = "https://example.org/profile/0.1"
TERMS = ["CreateAction", "UpdateAction", "CreativeWork", "Dataset", "File", "PropertyValue", "SoftwareApplication", "about", "conformsTo", "hasPart", "mentions", "name", "description", "datePublished", "license", "sha256", "contentSize", "encodingFormat", "instrument", "object", "result", "position", "value", "softwareVersion", "actionStatus"]


def state(n, uuid, producer=None, sequence=None, **more):
    found = {"state_id": U(n), "object_uuid": U(uuid), "kind": "signal", "fingerprint": {"scheme": "s", "value": f"sha256:{n:064d}"}, "dtype": "float64", "length": 4, "rows": ["x", "y"], "units": {"x": "s", "y": ""}, "limits": [], "produced_by": producer and U(producer)}
    return found | ({} if sequence is None else {"sequence": sequence}) | more


def activity(n, inputs, outputs, operation="lib.op", **more):
    return {"activity_id": U(n), "command_id": U(700 + n), "call": {"operation": operation and {"id": operation, "contract_version": 1}, "parameters": {"a": {"$float": "NaN"}}, "inputs": [{"role": r, "binding": {"state_id": U(s)}} for r, s in inputs]}, "implementation": None, "outputs": [{"role": r, "state_id": U(s)} for r, s in outputs], "context": {}, "limits": [], "environment_id": None, "edition": None, "origin": "ordinary", "status": "completed"} | more


def document(workspace, states, activities, environments=None):
    return json.dumps({"workspace_id": workspace, "environments": environments or {}, "states": {s["state_id"]: s for s in states}, "activities": activities})


def good():
    return [state(1, 101, sequence=0), state(2, 102, sequence=1), state(3, 103, 201, 2)], [activity(201, [("source", 1), ("operand", 2)], [("result", 3)])]


def ledgers_of(spark, *texts):
    return ledger.from_json(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_valid_ledger_and_tables(spark):
    env = {"edition": "desktop", "edition_version": "1", "packages": {"numpy": "2.3.0"}}
    acts = good()[1]
    acts[0]["environment_id"] = canon.json_digest(env)
    found = ledgers_of(spark, document("w", good()[0], acts, {canon.json_digest(env): env}))
    assert ledger.validate(found).count() == 0
    assert [(r.role, r.position) for r in found.inputs.orderBy("position").collect()] == [("source", 0), ("operand", 1)]
    assert {r.state_id for r in history.latest_states(found.states).collect()} == {U(1), U(2), U(3)}
    assert history.next_sequence(found.states).first().next_sequence == 3
    text = json.loads(ledger.to_json(found).first().text)
    assert list(text["states"]) == [U(1), U(2), U(3)] and text["activities"][0]["call"]["inputs"][1]["role"] == "operand"


def broken():
    def case(change):
        s, a = good()
        change(s, a)
        return document("w", s, a)

    yield case(lambda s, a: a[0]["call"]["inputs"][0]["binding"].update(state_id=U(9))), "unknown input state"
    yield case(lambda s, a: a.append(a[0])), "duplicate activity_id"
    yield case(lambda s, a: s[1].update(sequence=0)), "state sequences are not unique"
    yield case(lambda s, a: a[0].update(environment_id="sha256:x")), "unknown environment"
    yield case(lambda s, a: s[2].update(produced_by=U(5))), "output state names another producer"
    yield case(lambda s, a: s[2].update(produced_by=U(5))), "producer does not list it as output"
    yield case(lambda s, a: a[0]["outputs"].append({"role": "r", "state_id": U(8)})), "unknown output state"
    yield case(lambda s, a: a[0]["outputs"].append({"role": "r", "state_id": U(3)})), "output state produced twice"
    yield case(lambda s, a: a[0]["call"].update(operation=None)), "an opaque call needs an implementation"
    yield case(lambda s, a: a[0]["call"]["operation"].update(id="Bad Op")), "invalid operation identifier"
    yield case(lambda s, a: a[0]["call"]["operation"].update(contract_version=0)), "contract_version is an integer of 1 or more"
    yield case(lambda s, a: a[0]["call"]["inputs"][0].update(role="")), "a role is a non-empty text"
    yield case(lambda s, a: a[0]["call"]["inputs"][0].update(binding={"step": "x"})), "step bindings are reserved"
    yield case(lambda s, a: a[0]["call"]["inputs"][0].update(binding={"object_uuids": [U(1)]})), "object bindings are for legacy activities"
    yield case(lambda s, a: a[0].update(origin="legacy_metadata", legacy={"observed_state_id": U(9)})), "unknown observed state"
    yield case(lambda s, a: a[0].update(origin="legacy_metadata", legacy={})), "a legacy activity names no operation"
    yield document("w", good()[0], good()[1], {"sha256:0": {"edition": "x"}}), "identifier does not match"


def test_one_broken_thing_each(spark):
    cases = [(t.replace('"w"', f'"w{i}"', 1), p) for i, (t, p) in enumerate(broken())]
    found = {(r.workspace_id, r.problem) for r in ledger.validate(ledgers_of(spark, *[t for t, _ in cases])).collect()}
    assert not [p for i, (_, p) in enumerate(cases) if (f"w{i}", p) not in found]


def test_recording_compares_with_the_latest_only(spark):
    known = spark.createDataFrame([("w", "o", 5, 0, "signal", "A", None)], "workspace_id string, object_uuid string, sequence long, pos long, kind string, fp_value string, roi_digest string")
    seen = [("w", "o", i, "signal", f, None, False) for i, f in enumerate(["A", "B", "B", "A", None, None])] + [("w", "p", 9, "signal", "A", None, False), ("w", "p", 10, "signal", "A", None, True)]
    rows = spark.createDataFrame(seen, "workspace_id string, object_uuid string, ord long, kind string, fp_value string, roi_digest string, fresh boolean")
    got = [(r.object_uuid, r.ord, r.sequence) for r in ledger.record_states(known, rows).orderBy("sequence").collect()]
    assert got == [("o", 1, 6), ("o", 3, 7), ("o", 4, 8), ("o", 5, 9), ("p", 9, 10), ("p", 10, 11)]


def graph_of(attachments=(), workspace=b"ws", change=None, sign=True):
    files = [{"@id": "workspace.h5", "@type": "File", "name": "workspace", "sha256": canon.digest_of(workspace)[7:], "contentSize": str(len(workspace))}]
    files += [{"@id": f"attachments/{n}", "@type": "File", "name": n, "sha256": canon.digest_of(d)[7:], "contentSize": str(len(d)), "encodingFormat": "text/plain", "dlc:attachment": True} for n, d in attachments]
    op = {"@id": "#operation-lib.op-v1", "@type": "SoftwareApplication", "name": "lib.op", "softwareVersion": "1", "dlc:operationId": "lib.op"}
    binds = [{"@id": f"#activity-{U(201)}-input-{i}", "@type": "dlc:RoleBinding", "name": r, "position": i, "dlc:state": {"@id": f"#state-{i}"}} for i, r in enumerate(("source", "operand"))]
    states = [{"@id": f"#state-{i}", "@type": "CreativeWork", "name": f"s{i}"} for i in range(2)]
    action = {"@id": f"#activity-{U(201)}", "@type": "CreateAction", "name": "lib.op", "instrument": [{"@id": op["@id"]}], "dlc:inputs": [{"@id": b["@id"]} for b in binds], "dlc:outputs": [], "dlc:replayable": True}
    root = {"@id": "./", "@type": "Dataset", "name": "n", "description": "d", "datePublished": "2026-01-01", "license": "none", "conformsTo": [{"@id": manifest.PROCESS_PROFILE}, {"@id": PROFILE}], "hasPart": [{"@id": f["@id"]} for f in files], "mentions": [{"@id": action["@id"]}]}
    head = {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}, "conformsTo": {"@id": manifest.CRATE}}
    doc = {"@context": [manifest.CRATE_CONTEXT, {"dlc": "x"}], "@graph": [head, root, *files, op, *binds, *states, action]}
    if change:
        change({e["@id"]: e for e in doc["@graph"]}, doc)
    if sign:
        root["dlc:manifestFingerprint"] = manifest.manifest_fingerprint(doc)
    return doc


A = f"#activity-{U(201)}"
DEFECTS = {
    "context without RO-Crate 1.3": lambda e, d: d.update({"@context": "x"}),
    "descriptor is not about ./": lambda e, d: e["ro-crate-metadata.json"].update(about={"@id": "#x"}),
    "root is no Dataset": lambda e, d: e["./"].update({"@type": "File"}),
    "root has no text as license": lambda e, d: e["./"].update(license=7),
    f"root does not conform to {PROFILE}": lambda e, d: e["./"]["conformsTo"].pop(),
    "not one workspace file": lambda e, d: e["./"].update(hasPart=[]),
    "workspace without sha256": lambda e, d: e["workspace.h5"].update(sha256="x"),
    "workspace without size": lambda e, d: e["workspace.h5"].update(contentSize="01"),
    "workspace is neither included nor referenced": lambda e, d: e["workspace.h5"].update({"dlc:referenced": True}),
    "actions and mentions differ": lambda e, d: e["./"].update(mentions=[]),
    "undefined type": lambda e, d: e["#state-0"].update({"@type": "Nonsense"}),
    "undefined term odd": lambda e, d: e["#state-0"].update(odd=1),
    "dangling reference #gone": lambda e, d: e["#state-0"].update(object={"@id": "#gone"}),
    "action without instrument": lambda e, d: e[A].update(instrument=[]),
    "replayable flag and instrument differ": lambda e, d: e[A].update({"dlc:replayable": False}),
    "dlc:inputs positions are not in order": lambda e, d: e[A]["dlc:inputs"].reverse(),
    "parent is no other manifest": lambda e, d: e["./"].update({"dlc:revisionOf": "sha256:x"}),
    "invalid dlc:roi": lambda e, d: e["#state-0"].update({"dlc:roi": "{"}),
    "entity stands twice": lambda e, d: d["@graph"].append({"@id": "#state-0", "@type": "CreativeWork"}),
    "invalid attachment digest": lambda e, d: e["attachments/a.txt"].update(sha256="0"),
    "attachment name is not its file name": lambda e, d: e["attachments/a.txt"].update(name="b.txt"),
}


def test_manifest_rules(spark):
    docs = [("good", graph_of([("a.txt", b"a")]))] + [(p, graph_of([("a.txt", b"a")], change=c)) for p, c in DEFECTS.items()]
    tampered = graph_of()
    tampered["@graph"][1]["name"] = "other"
    rows = [(n, json.dumps(d)) for n, d in docs] + [("tampered", json.dumps(tampered)), ("deep", "[" * 70 + "]" * 70)]
    found = manifest.validate(manifest.properties(spark.createDataFrame(rows, "manifest string, text string")), PROFILE, TERMS)
    by = {}
    for r in found.collect():
        by.setdefault(r.manifest, set()).add(r.problem)
    assert "good" not in by, by.get("good")
    for problem in DEFECTS:
        assert problem in by[problem], (problem, by[problem])
    assert by["tampered"] == {"fingerprint does not match"} and any(p.startswith("unreadable") for p in by["deep"])


def test_manifest_summary(spark):
    props = manifest.properties(spark.createDataFrame([("m", json.dumps(graph_of()))], "manifest string, text string"))
    row = manifest.summary(props).first()
    assert row.name == "lib.op" and row.replayable and [(b.role, b.target) for b in row.inputs] == [("source", "#state-0"), ("operand", "#state-1")]


def test_capsules_round_trip_and_defects(spark, tmp_path):
    import io
    import zipfile

    doc = json.dumps(graph_of([("a.txt", b"note")])).encode()
    parts = [("ro-crate-metadata.json", doc), ("workspace.h5", b"ws"), ("attachments/a.txt", b"note")]
    rows = [("good", n, bytearray(c)) for n, c in parts]
    made = capsule.create(spark.createDataFrame(rows, "capsule string, name string, content binary")).first()
    assert bytes(made.content) == capsule.archive_bytes(parts) and made.sha256 == canon.digest_of(bytes(made.content))
    (tmp_path / "good.cap").write_bytes(bytes(made.content))
    (tmp_path / "altered.cap").write_bytes(capsule.archive_bytes([*parts[:1], ("workspace.h5", b"xx"), parts[2]]))
    (tmp_path / "extra.cap").write_bytes(capsule.archive_bytes([*parts, ("attachments/b.txt", b"b")]))
    (tmp_path / "path.cap").write_bytes(capsule.archive_bytes([*parts, ("../x", b"b")]))
    (tmp_path / "bare.cap").write_bytes(capsule.archive_bytes(parts[1:]))
    (tmp_path / "junk.cap").write_bytes(b"no archive")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in parts:
            z.writestr(n, c)
    (tmp_path / "packed.cap").write_bytes(packed.getvalue())
    reviews = spark.createDataFrame([(f"file:{tmp_path}/good.cap", "r1", [U(201)]), (f"file:{tmp_path}/extra.cap", "r2", [U(9)])], "capsule string, review string, cited array<string>")
    verdicts, problems = verify.verify(spark, str(tmp_path), PROFILE, TERMS, reviews)
    got = {r.capsule.rsplit("/", 1)[1]: r for r in verdicts.collect()}
    why = {}
    for r in problems.collect():
        why.setdefault(r.capsule.rsplit("/", 1)[1], set()).add((r.subject, r.problem))
    assert got["good.cap"].valid and got["good.cap"].workspace == "integrity_only" and sum(r.valid for r in got.values()) == 1, why
    assert ("workspace.h5", "altered") in why["altered.cap"] and ("attachments/b.txt", "undeclared") in why["extra.cap"]
    assert ("r2", "cites an activity the capsule has not") in why["extra.cap"]
    assert ("../x", "parent") in why["path.cap"] and ("archive", "no manifest") in why["bare.cap"] and ("workspace.h5", "compressed") in why["packed.cap"]
    assert any(p.startswith("unreadable") for _, p in why["junk.cap"])
    kept = capsule.read_entries(spark, f"{tmp_path}/good.cap", contents=True)
    assert bytes(capsule.attachment(kept, "a.txt").first().content) == b"note"


def test_compared_rows(spark):
    nan, inf = float("nan"), float("inf")
    cases = {
        "equal": ([1.0, nan], [1.0, nan], "exact"), "zero": ([0.0], [-0.0], "exact"), "near": ([1.0, 2.0], [1.0, 2.0000001], "within_tolerance"),
        "far": ([1.0], [2.0], "different"), "moved": ([nan, 1.0], [1.0, nan], "different"), "short": ([1.0, 2.0], [1.0], "different"), "inf": ([1.0], [inf], "different"), "empty": ([], [], "exact"),
    }
    side = lambda i: spark.createDataFrame([(k, 0, "y", "float64", v[i]) for k, v in cases.items()], "k string, ord int, row string, dtype string, values array<double>")
    got = {r.k: r for r in compare.compared_rows(side(0), side(1), ["k"], F.lit("tolerance"), rtol=1e-6).collect()}
    assert {k: r.verdict for k, r in got.items()} == {k: v[2] for k, v in cases.items()}
    assert got["short"].mismatches == 2 and got["short"].max_abs is None and got["moved"].undefined_abs == 2 and got["inf"].max_abs is None and got["far"].max_abs == 1.0


def test_complex_errors(spark):
    df = spark.createDataFrame([((1.0, 1.0), (1.0, 1.0)), ((3.0, 4.0), (0.0, 0.0))], "ref struct<re:double,im:double>, cand struct<re:double,im:double>")
    assert [(r._off, r._abs, r._rel) for r in compare.complex_pairs(df).collect()] == [(False, 0.0, 0.0), (True, 5.0, 1.0)]


def test_artifacts(spark):
    make = lambda *rows: spark.createDataFrame([(k, ["n", "t"], d) for k, d in rows], "k string, names array<string>, data array<array<string>>")
    ref = make(("same", [["1.0", "a"], [None, "b"]]), ("text", [["1", "a"]]), ("number", [["1", "a"]]), ("hole", [["1", "a"], ["2", "b"]]))
    cand = make(("same", [["1", "a"], [None, "b"]]), ("text", [["1", "x"]]), ("number", [["1.0000001", "a"]]), ("hole", [["1", "a"], [None, "b"]]))
    got = {r.k: r.verdict for r in compare.compared_artifacts(ref, cand, ["k"], F.lit("tolerance"), atol=1e-3).collect()}
    assert got == {"same": "exact", "text": "different", "number": "within_tolerance", "hole": "different"}


def test_environments_and_verdicts(spark):
    env = lambda d: spark.createDataFrame([("a", i, v) for i, v in d.items()], "k string, item string, value string")
    assert compare.environment_match(env({"x": "1", "y": "2"}), env({"x": "1", "z": None}), ["k"]).first().asDict() == {"k": "a", "match": "different", "differences": 1}
    out = spark.createDataFrame([("r", 0, "exact"), ("r", 1, "not_verified"), ("s", 0, "within_tolerance")], "k string, position int, verdict string")
    assert {r.k: r.verdict for r in compare.overall(out, ["k"]).collect()} == {"r": "not_verified", "s": "within_tolerance"}


def test_ancestry_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), (None, "x")], "child string, parent string")
    start = spark.createDataFrame([("a",), ("d",), (None,)], "s string")
    want = {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("d", "d", 0)}
    assert {tuple(r) for r in graph.ancestry(edges, start).collect()} == want
    assert {tuple(r) for r in graph.ancestry_sql(edges, start.where("s is not null")).collect()} == want
    assert max(r.depth for r in graph.ancestry(edges, start, depth=1).collect()) == 1
    assert {tuple(r) for r in graph.ancestries(edges, start).collect()} == want


def test_closure_of_random_graphs_and_long_chains(spark):
    rng = np.random.default_rng(6)
    for n, m in ((12, 14), (12, 30), (1, 0)):
        pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (m, 2))]
        want = {}
        for s in {a for a, _ in pairs}:
            level, seen, d = {s}, {s}, 0
            while level:
                want |= {(s, x): d for x in level if d}
                level, d = {b for a, b in pairs if a in level} - seen, d + 1
                seen |= level
        edges = spark.createDataFrame(pairs, "child string, parent string")
        assert {(r.start, r.node): r.depth for r in graph.closure(edges).collect()} == want
    line = spark.range(300).selectExpr("id as fingerprint", "case when id > 0 then id - 1 end as revision_of")
    assert graph.chain(line).count() == 300 * 301 // 2
    assert graph.chain(line, depth=64).agg({"depth": "max"}).first()[0] == 64


def test_unique_names_pass_over_taken_ones(spark):
    rows = [(1, "a"), (2, "a"), (3, "a"), (4, "2-a"), (5, "2-a"), (6, "a"), (7, "4-a")]
    got = {r.i: r.u for r in history.unique_names(spark.createDataFrame(rows, "i int, base string"), "base", ["i"], "u").collect()}
    assert got == {1: "a", 2: "3-a", 3: "5-a", 4: "2-a", 5: "2-2-a", 6: "6-a", 7: "4-a"}


def test_status_cascades(spark):
    rows = [(None, "a", None, None, None), ("a", "a", None, None, "altered"), ("a", "b", None, None, None), ("a", "a", "r", None, None), ("a", "a", "r", "r", None)]
    df = spark.createDataFrame(rows, "fp string, now string, roi string, roi_now string, file string")
    assert [r[0] for r in df.select(check.same_state(df.fp, df.now, df.roi, df.roi_now, df.file)).collect()] == ["unsupported", "altered", "changed", "roi_changed", "available"]


def test_message_and_assert(spark):
    found = spark.createDataFrame([(str(i), "bad") for i in range(9)], "subject string, problem string")
    assert tuple(check.message(found, 2).first()) == (9, "0: bad; 1: bad")
    with pytest.raises(ValueError, match="0: bad"):
        check.assert_valid(found)
    check.assert_valid(found.limit(0))


def test_legacy_roles(spark):
    df = spark.createDataFrame([("1-to-1", 1), ("2-to-1", 2), ("n-to-1", 3), ("odd", 1), (None, 1)], "p string, n int")
    assert [r[0] for r in df.select(legacy.roles(df.p, df.n)).collect()] == [["source"], ["source", "operand"], ["sources"] * 3, None, None]


def test_stream_observes_as_the_batch_does(spark, tmp_path):
    contents = ["A", "B", "B", "A", None, None, "C"]
    rows = [("o", i, c) for i, c in enumerate(contents)] + [("p", i, "A") for i in range(5)]
    schema = "object_uuid string, ord long, content string"
    for k, part in enumerate((rows[:3] + rows[7:9], rows[3:7] + rows[9:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = observe.observe_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    got = sorted((r.object_uuid, r.ord, r.content, r.state_no) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = history.observe(spark.createDataFrame(rows, schema), "object_uuid", ["ord"], ["content"], known=F.col("content").isNotNull())
    assert got == sorted((r.object_uuid, r.ord, r.content, r.state_no) for r in batch.collect()) and len(got) == 7


def test_publication_is_idempotent(spark, tmp_path):
    run = observe.publish_batches(f"{tmp_path}/pub")
    batch = spark.createDataFrame([("f1", 1), ("f2", 2), ("f1", 1)], "fingerprint string, n int")
    run(batch, 0)
    run(batch.where("n = 2").unionByName(spark.createDataFrame([("f3", 3)], batch.schema)), 1)
    run(batch, 2)
    run(batch, 2)
    assert sorted(r.fingerprint for r in spark.read.parquet(f"{tmp_path}/pub").collect()) == ["f1", "f2", "f3"]
    assert registry.listing(spark.createDataFrame([(str(i), i) for i in range(5)], "fingerprint string, published_at int"), 2).count() == 2


def test_array_payloads_hash_as_bytes(spark):
    y = np.arange(4, dtype="<f4")
    a = fingerprint_of(spark, y.tobytes())
    assert a.fp_value == fingerprint_of(spark, bytes(y)).fp_value and a.dtype == "float32"


def fingerprint_of(spark, payload):
    from provspark.functions.fingerprint import state_facts

    df = spark.createDataFrame([("u", "signal", [0.0, 1.0, 2.0, 3.0], bytearray(payload), "<f4")], "object_uuid string, kind string, x array<double>, y binary, dtype string")
    return state_facts(df).first()
