"""The driver contract, and every catalogue query against its SQL."""

import importlib
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from provspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(plain(r[c] for c in cols) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    found = sql.execute(catalog.ORACLES[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == cols
    assert got == sorted(plain(r[order.index(c)] for c in cols) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_parts_are_all_there_or_all_absent():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    there = (Path(entry.__file__).parent / "provspark/llm/queries.py").exists()
    assert len(names) == (11 if there else 0) or sum(n[:2] == "op" and n[2].isdigit() for n in names) == (10 if there else 0)


def test_core_does_not_import_optional_parts():
    for path in Path(catalog.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
    importlib.import_module("provspark.__main__")
