"""The stages of the corpus pipeline against plain versions, each on its own input."""

import json

import pytest
from test_operators import plain_dedup, plain_hits
from test_simhash import plain_groups

import corpus_pipeline
from provspark.llm import qualityclf

public = pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"p{i}" for i in range(55))
    item = " ".join(f"b{i}" for i in range(20))
    rows = []
    for i in range(160):
        junk = i % 4 == 3
        body = "\n".join(" ".join(f"word{(i * 37 + j * 11 + k) % 971}{'###' if junk else ''}" for k in range(20)) for j in range(3))
        rows.append((i, body, "en", "s", len(body)))
    rows += [(200, rows[0][1] + f"\n{passage}", "en", "s", 1), (201, rows[1][1] + f"\n{passage}\nmore", "en", "s", 1), (202, f"start {item} end", "en", "s", 1), (203, None, "en", "s", None), (204, rows[2][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i % 4 == 3 else 1, 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = qualityclf.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == COLUMNS, name
            after = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        if k == 0:
            kept = [(d, t) for d, t in before if qualityclf.probability(t and t.encode(), net, net.tables()) >= 0.7]
            assert after == sorted(kept, key=repr) and 110 <= len(kept) < 150
        elif k == 1:
            assert after == sorted(((d, t) for d, t, _ in plain_dedup(before)[0]), key=repr)
            assert sum("p7 p8" in (t or "") for _, t in after) == 1
        elif k == 2:
            assert after == sorted(((d, t) for (d, t), g in zip(before, plain_groups(before)) if d == g[2]), key=repr)
        elif k == 3:
            hits = {d for d, *_ in plain_hits(before, [(1, " ".join(f"b{i}" for i in range(20)))])}
            assert hits <= {202} and after == sorted(((d, t) for d, t in before if d not in hits), key=repr)
        else:
            rows = out.collect()
            assert {r.doc_id for r in rows} == {d for d, _ in before}
            by = {}
            for r in rows:
                by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
            assert all(sum(n for _, n, _ in p) == p[0][2] for p in by.values())
        docs = out
    whole = corpus_pipeline.run(spark, folder)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in rows}
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
