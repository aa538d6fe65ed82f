"""Plans of steps that many queries share: texts are read where they are, rows of a workspace are shuffled once."""

import json
import re

from test_build import WORDS
from test_records import PROFILE, TERMS, document, graph_of, ledgers_of, state

from provspark.operators import manifest
from provspark.plans import build
from provspark.sources import capsule


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifests_are_judged_and_inspected_where_they_are(spark):
    texts = [("good", json.dumps(graph_of())), ("bad", json.dumps(graph_of(change=lambda _, d: d["@graph"].pop()))), ("junk", "{")]
    made = spark.createDataFrame(texts, "manifest string, text string")
    found = manifest.validate(made, PROFILE, TERMS)
    assert "Exchange" not in plan_of(found) and sorted(map(tuple, found.collect())) == sorted(map(tuple, manifest.validate(manifest.properties(made), PROFILE, TERMS).collect()))
    said, rows = manifest.inspect(made), manifest.inspect(manifest.properties(made))
    for table in ("roots", "attachments", "activities", "parameters", "states", "fan_out"):
        assert "Exchange" not in plan_of(getattr(said, table))
        assert sorted(map(str, getattr(said, table).collect())) == sorted(map(str, getattr(rows, table).collect()))


def test_building_gathers_a_workspace_once(spark):
    found = ledgers_of(spark, document("w", [state(1, 101, sequence=0)], []))
    locators = spark.createDataFrame([], "state_id string, kind string, path string")
    roots = spark.createDataFrame([("w", "n", "d", "l", "2026-01-01", None, None, "sha256:" + "0" * 64, 7)], "workspace_id string, name string, description string, license string, published string, revision_of string, workspace_ref string, workspace_sha256 string, workspace_size long")
    made = build.build(found, locators, roots, WORDS)
    assert len(re.findall(r"Exchange hashpartitioning\(workspace_id", plan_of(made))) == 1 and plan_of(made).count("MapInArrow") == 1
    assert made.count() == 1


def test_names_that_stand_twice_are_found_without_a_shuffle(spark):
    data = capsule.archive_bytes([("workspace.h5", b"a"), ("attachments/a", b"b"), ("attachments/a", b"c")])
    found = capsule.entries_of(spark.createDataFrame([("c", bytearray(data)), ("d", bytearray(data))], "capsule string, content binary"))
    assert "Exchange" not in plan_of(found)
    assert sorted(r.refusal or "" for r in found.collect()) == ["", "", *["duplicate"] * 4]
