"""Candidates run on executors; ledgers stored as tables."""

import pytest
from test_records import document, good, ledgers_of

from provspark.operators import execute, ledger


def test_candidates(spark):
    def add(inputs, parameters):
        return {"sum": [a + b + parameters["c"] for a, b in zip(inputs["source"], inputs["operand"])], "count": [len(inputs["source"])]}

    def mean(inputs, _):
        rows = inputs["sources"]
        return {"mean": [sum(c) / len(rows) for c in zip(*rows)]}

    calls = spark.createDataFrame(
        [("a", "add", '{"c": 1}', [("source", [1.0, 2.0]), ("operand", [3.0, 4.0])]), ("b", "mean", None, [("sources", [1.0]), ("sources", [3.0])]), ("c", "other", None, []), ("d", "add", "{}", [("source", [1.0])])],
        "activity_id string, operation_id string, parameters string, inputs array<struct<role:string,values:array<double>>>",
    )
    got = {(r.activity_id, r.role): (r.position, r["values"], r.problem) for r in execute.run_candidates(calls, {"add": add, "mean": mean}).collect()}
    assert got["a", "sum"] == (0, [5.0, 7.0], None) and got["a", "count"] == (1, [2.0], None) and got["b", "mean"] == (0, [2.0], None)
    assert got["c", None][2] == "unsupported_operation" and got["d", None][2].startswith("KeyError")
    refs = spark.createDataFrame([("a", "sum", [5.0, 7.0]), ("a", "gone", [1.0])], "activity_id string, role string, values array<double>")
    beside = {(r.activity_id, r.role): (r.reference, r.candidate) for r in execute.against_references(execute.run_candidates(calls, {"add": add}), refs).collect()}
    assert beside["a", "sum"] == ([5.0, 7.0], [5.0, 7.0]) and beside["a", "gone"] == ([1.0], None) and beside["a", "count"] == (None, [2.0])


def test_stored_tables(spark, tmp_path):
    found = ledgers_of(spark, document("w", *good()))
    ledger.write_tables(found, f"{tmp_path}/l")
    back = ledger.read_tables(spark, f"{tmp_path}/l")
    assert ledger.validate(back).count() == 0 and back.inputs.count() == 2
    with pytest.raises(Exception, match="exist"):
        ledger.write_tables(found, f"{tmp_path}/l")
