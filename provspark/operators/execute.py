"""Candidate execution: registered functions run on the executors, one call a recorded activity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.functions.canon import load_json

#: A function of (inputs by role, parameters) that gives outputs by role; an input or output is a list of numbers.
Candidate = Callable[[Mapping[str, list], Mapping], Mapping[str, list]]
OUTPUTS = "activity_id string, position int, role string, values array<double>, problem string"


def run_candidates(calls: DataFrame, functions: Mapping[str, Candidate]) -> DataFrame:
    """Outputs of ``calls(activity_id, operation_id, parameters, inputs array<struct<role, values>>)``.

    Only the named functions are run; received code never is. An operation without a function, and a call that
    raises, gives one row with a ``problem``. Repeated roles are numbered in order. No shuffle: a call and its inputs are one row.
    """
    known = dict(functions)

    def rows(call) -> Iterator[tuple]:
        ident = call["activity_id"]
        function = known.get(call["operation_id"])
        if function is None:
            yield ident, None, None, None, "unsupported_operation"
            return
        try:
            given: dict[str, list] = {}
            for item in call["inputs"]:
                given.setdefault(item["role"], []).append(list(item["values"]))
            inputs = {role: found[0] if len(found) == 1 else found for role, found in given.items()}
            outputs = function(inputs, load_json(call["parameters"]) if call["parameters"] else {})
            for position, (role, values) in enumerate(outputs.items()):
                yield ident, position, role, [float(v) for v in values], None
        except Exception as error:  # noqa: BLE001  a candidate may fail in any way; the report says how
            yield ident, None, None, None, f"{type(error).__name__}: {error}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = pd.DataFrame([r for c in part.to_dict("records") for r in rows(c)], columns=[c.split()[0] for c in OUTPUTS.split(", ")])
            found["position"] = found["position"].astype("Int32")
            yield found

    return calls.select("activity_id", "operation_id", "parameters", "inputs").mapInPandas(run, OUTPUTS)


def against_references(outputs: DataFrame, references: DataFrame) -> DataFrame:
    """Candidate outputs beside the recorded ones, ``references(activity_id, role, values)``, ready for comparison."""
    made = outputs.where("problem is null").select("activity_id", "role", F.col("values").alias("candidate"))
    return references.withColumnRenamed("values", "reference").join(made, ["activity_id", "role"], "full_outer")
