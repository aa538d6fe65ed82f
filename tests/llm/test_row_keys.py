"""Rows without an id, and ids with two texts, in the stages that remove rows."""

import pytest

import corpus_pipeline
from provspark.llm import decontam, qualityclf


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def words(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_near_stage_keeps_one_row_of_each_group(spark):
    rows = [(1, words("a")), (2, words("a")), (2, words("b")), (3, words("b")), (None, words("a")), (None, words("c")), (None, words("c")), (None, None), (5, words("d")), (5, words("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, words("a")), (2, words("b")), (None, words("c")), (None, None), (5, words("d"))]
    assert texts(corpus_pipeline.near_duplicates(spark, docs, "")) == sorted(want, key=repr)


def test_decontamination_goes_by_text(spark):
    item = words("b", 20)
    rows = [(1, f"x {item} y"), (1, words("clean")), (None, f"z {item}"), (None, words("free")), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert texts(decontam.drop_contaminated(docs, items)) == sorted([rows[1], rows[3], rows[4]], key=repr)


def test_classifier_goes_by_text(spark, monkeypatch):
    monkeypatch.setattr(qualityclf, "train", lambda docs, labels: qualityclf.fit([b"good words " * 9, b"###$$$ " * 9] * 8, [1, 0] * 8))
    rows = [(1, "good words " * 9), (1, "###$$$ " * 9), (None, "good words " * 8), (None, "###$$$ " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert texts(qualityclf.keep_good(docs, docs)) == sorted([rows[0], rows[2]], key=repr)
