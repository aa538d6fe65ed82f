"""Values stored as trees of groups, attributes and datasets, read back as JSON: dictionaries, sequences, arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.functions.canon import MAX_DEPTH, canonical_json

#: Marks of a group that is a dictionary or a sequence, and the most nodes of one value.
DICT, SEQ, MAX_NODES = "__dict", "__seq", 10_000


def value_of(nodes: dict[str, tuple[dict, object]], path: str = "", most: int = MAX_NODES, depth: int = MAX_DEPTH):
    """The value of the node at ``path``; ``nodes`` gives, by path, a group's attributes, or an empty dictionary and a dataset's value.

    ValueError for a node of no kind, a missing item, too many nodes, or nesting beyond ``depth``.
    """
    children: dict[str, list[str]] = {}
    for p in sorted(nodes):
        if p != path:
            children.setdefault(p.rpartition("/")[0], []).append(p)
    seen = 0

    def read(at: str, level: int):
        nonlocal seen
        seen += 1
        if seen > most or level > depth:
            raise ValueError(f"{'too many nodes' if seen > most else 'nested too deeply'}: {at}")
        attributes, data = nodes[at]
        if data is not None:
            return data
        below = {c.rpartition("/")[2]: c for c in children.get(at, ())}
        if SEQ in attributes:
            items = []
            for i in range(int(attributes[SEQ])):
                name = f"{SEQ}{i}"
                if name not in below and name not in attributes:
                    raise ValueError(f"no item {i}: {at}")
                items.append(read(below[name], level + 1) if name in below else attributes[name])
            return items
        if DICT not in attributes:
            raise ValueError(f"unknown node: {at}")
        return {k: v for k, v in attributes.items() if k != DICT} | {k: read(c, level + 1) for k, c in below.items()}

    if path not in nodes:
        raise ValueError(f"no node: {path}")
    return read(path, 1)


def decoded(nodes: DataFrame, keys: list[str], root: str = "") -> DataFrame:
    """``(keys, json, problem)``: the canonical JSON of each key's tree ``nodes(keys, path, attributes, data)``, or why there is none.

    ``attributes`` and ``data`` are JSON texts; ``data`` is null for groups. A tree over the limit of nodes is refused before
    its values are gathered.
    """

    def one(found: list) -> tuple:
        if len(found) > MAX_NODES:
            return None, "too many nodes"
        try:
            held = {n["path"]: (json.loads(n["attributes"] or "{}"), None if n["data"] is None else json.loads(n["data"])) for n in found}
            return canonical_json(value_of(held, root)), None
        except (ValueError, TypeError, RecursionError) as error:
            return None, str(error)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [one(list(x)) for x in part["_nodes"]]
            yield part[keys].assign(json=[m[0] for m in made], problem=[m[1] for m in made])

    sized = nodes.groupBy(*keys).agg(F.count("*").alias("_n"))
    small = nodes.join(sized, keys).where(F.col("_n") <= MAX_NODES)
    grouped = small.groupBy(*keys).agg(F.collect_list(F.struct("path", "attributes", "data")).alias("_nodes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*keys).schema)
    read = grouped.mapInPandas(run, f"{schema}, json string, problem string")
    large = sized.where(F.col("_n") > MAX_NODES).select(*keys, F.lit(None).cast("string").alias("json"), F.lit("too many nodes").alias("problem"))
    return read.unionByName(large)
