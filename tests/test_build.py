"""Manifests from ledgers, reviews, reports and environments."""

import json

import pytest
from pyspark.sql import functions as F
from test_records import PROFILE, TERMS, U, activity, document, ledgers_of, state

from provspark.functions import canon, environment
from provspark.operators import manifest, review
from provspark.plans import build

WORDS = build.Vocabulary(PROFILE, "profile", "0.1", "https://example.org/terms#", "workspace", editions={"desktop": "Desk"})


def made(spark):
    env = {"edition": "desktop", "edition_version": "1.4", "python": {"implementation": "CPython", "version": "3.12"}, "packages": {"numpy": "2.3.0", "h5py": None}}
    states = [state(1, 101, sequence=0, roi={"definition": {"b": 1, "a": [1.0]}, "digest": "sha256:x"}), state(2, 102, sequence=1), state(3, 103, 201, 2)]
    one = activity(201, [("source", 1), ("operand", 2)], [("result", 3)], environment_id=canon.json_digest(env), edition="desktop", context={"x_alignment": {"rule": "r", "version": 1}}, started_at="2026-01-01T00:00:00.000Z")
    one["call"]["parameters"] = {"n": 1, "s": "é\n", "none": None, "list": [1, 2.50]}
    two = activity(202, [("source", 3)], [], None, implementation={"package": "p", "version": "1", "python_name": "f"})
    two["outputs"] = [{"role": "result", "artifact": {"kind": "table", "object_uuid": U(103), "key": "k", "digest": "sha256:y"}}]
    text = document("w", states, [one, two], {canon.json_digest(env): env})
    found = ledgers_of(spark, text)
    locators = spark.createDataFrame([(U(1), "signal", "/p/g/o")], "state_id string, kind string, path string")
    roots = spark.createDataFrame([("w", "n", "d", "l", "2026-01-01", None, None, "sha256:" + "0" * 64, 7)], "workspace_id string, name string, description string, license string, published string, revision_of string, workspace_ref string, workspace_sha256 string, workspace_size long")
    files = spark.createDataFrame([("w", 0, "b.txt", "text/plain", 3, "sha256:" + "1" * 64, ""), ("w", 1, "a.txt", "text/plain", 4, "sha256:" + "2" * 64, "note")], "workspace_id string, ord int, name string, media_type string, size long, sha256 string, description string")
    return build.build(found, locators, roots, WORDS, files).first()


def test_manifest_of_a_ledger(spark):
    row = made(spark)
    doc = json.loads(row.text)
    assert row.text == canon.canonical_json(doc) and row.fingerprint == manifest.manifest_fingerprint(doc) == doc["@graph"][1]["dlc:manifestFingerprint"]
    by = {e["@id"]: e for e in doc["@graph"]}
    ids = [e["@id"] for e in doc["@graph"]]
    assert ids[:7] == ["ro-crate-metadata.json", "./", manifest.PROCESS_PROFILE, PROFILE, "workspace.h5", "attachments/b.txt", "attachments/a.txt"] and ids[7:] == sorted(ids[7:])
    one, two = by[f"#activity-{U(201)}"], by[f"#activity-{U(202)}"]
    assert one["instrument"] == [{"@id": "#operation-lib.op-v1"}, {"@id": "#edition-desktop-1.4"}] and by["#edition-desktop-1.4"]["name"] == "Desk"
    assert two["instrument"] == [{"@id": "#implementation-f-1"}] and two["dlc:replayable"] is False and two["result"] == [{"@id": f"#activity-{U(202)}-artifact-0"}]
    assert by[f"#activity-{U(201)}-parameter-s"]["value"] == "é\n" and by[f"#activity-{U(201)}-parameter-list"]["value"] == "[1,2.5]" and "value" not in by[f"#activity-{U(201)}-parameter-none"]
    assert by[f"#state-{U(1)}"]["dlc:roi"] == '{"a":[1],"b":1}' and by[f"#state-{U(1)}"]["isPartOf"] == {"@id": "workspace.h5"} and "isPartOf" not in by[f"#state-{U(2)}"]
    assert by[f"#state-{U(3)}"]["dlc:producedBy"] == {"@id": f"#activity-{U(201)}"} and by["#package-h5py-None"]["softwareVersion"] == "None"
    assert "description" not in by["attachments/b.txt"] and one["dlc:xAlignment"] == '{"rule":"r","version":1}'
    props = manifest.properties(spark.createDataFrame([("m", row.text)], "manifest string, text string"))
    terms = [*TERMS, "identifier", "softwareRequirements", "isPartOf", "startTime", "endTime", "version"]
    assert manifest.validate(props, PROFILE, terms).collect() == []
    assert [(r.name, len(r.inputs)) for r in manifest.summary(props).collect()] == [("lib.op", 2), ("f", 1)]


def test_reviews(spark):
    cited = spark.createDataFrame([("sha256:" + "a" * 64, "me", None, "2026-01-01", "fine \"so\"", None, [(U(1), "exact")])], "target string, reviewer string, ident string, date string, statement string, verdict string, cited array<struct<activity_id:string,verdict:string>>")
    body = cited.select(review.review_json("review", *[F.col(c) for c in cited.columns]).alias("j")).withColumn("fp", review.signed(F.col("j"))).first()
    doc = json.loads(body.j)
    assert body.j == canon.canonical_json(doc) and body.fp == canon.json_digest(doc)
    good = doc | {"review_fingerprint": body.fp}
    cases = [good, good | {"statement": "other"}, good | {"verdict": "odd"}, good | {"target": "x"}, {k: v for k, v in good.items() if k != "reports"}]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, text string")
    got = {r.i: r.problems for r in review.review_problems(rows).collect()}
    assert got[0] == [] and got[1] == ["fingerprint does not match"] and "unknown verdict" in got[2] and "invalid target" in got[3] and "invalid reports" in got[4]


def test_reports(spark):
    good = {"activity_id": U(1), "restoration": "included", "eligibility": "ready", "inputs": [], "environment": {"match": "same"}, "verdict": "different", "outputs": [{"role": "r", "verdict": "exact"}, {"role": "s", "verdict": "different"}]}
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate([good, good | {"verdict": "probably"}, good | {"verdict": "exact"}, good | {"outputs": [], "verdict": "not_verified"}])], "i int, text string")
    got = {r.i: r.problems for r in review.report_problems(rows).collect()}
    assert got[0] == [] and "unknown verdict" in got[1] and got[2] == ["verdict is not the most severe"] and got[3] == []
    acts = spark.createDataFrame([("a", "included", "ready", "same"), ("b", "included", "missing_input", "same"), ("c", "included", "ready", "same")], "activity_id string, restoration string, eligibility string, match string")
    outs = spark.createDataFrame([("a", 0, "r", "not_verified", None, None), ("a", 1, "s", "within_tolerance", "tolerance", 3)], "activity_id string, position int, role string, verdict string, rule string, mismatches long")
    assert {r.activity_id: (r.verdict, r.rule, r.mismatches) for r in review.build_reports(acts, outs).collect()} == {"a": ("not_verified", "tolerance", 3), "b": ("not_verified", None, None), "c": ("not_verified", None, None)}


def test_environment():
    found = environment.collect("web", "1", packages=["numpy", "no-such-package"])
    assert found["packages"]["no-such-package"] is None and environment.environment_id(found).startswith("sha256:")
    with pytest.raises(ValueError):
        environment.collect("other", "1")
    good = {"fingerprint": "sha256:" + "0" * 64, "name": None, "attachments": ["a"]}
    assert environment.check_origin(good) == good
    for bad in ({}, good | {"name": 1}, good | {"fingerprint": "0" * 64}, good | {"attachments": [1]}, good | {"attachments": ["a"] * 1001}):
        with pytest.raises(ValueError):
            environment.check_origin(bad)
    assert environment.media_type("a.txt") == "text/plain" and environment.media_type("a.?") == "application/octet-stream"
