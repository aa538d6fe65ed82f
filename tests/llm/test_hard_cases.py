"""Hot keys, hostile pages, many blocks, and plain versions of what other tests take on trust."""

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.llm import common, decontam, qualityclf, queries, sharding, urlfilter


def test_url_sql_follows_aliases(spark, tmp_path):
    link, meta = '<link rel="canonical" href="{}">', "<META http-equiv=refresh content='0; URL={}'>"
    rng = np.random.default_rng(3)
    urls = [f"http://{h}/{q}" for h in ("a.org", "B.org", "x.net", "example.com", "www.example.com", "c.com") for q in ("", "es/p", "en/q", "one?x=1", "two#f")]
    pages = [(i, u, "".join((link if rng.random() < 0.5 else meta).format(rng.choice([*urls, "/one?x=1", "two", "//a.org/", "?p"])) for _ in range(int(rng.integers(0, 3))))) for i, u in enumerate(urls)]
    pages += [(100, None, link.format("http://x.net/es/")), (101, "no url", "<link rel=canonical href=/x>"), (102, urls[3], None), (103, "http://d.org", link.format("http://d.org/#top") + link.format("http://x.net/fr/z"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.OP1_SQL).fetchall()
    got = [tuple(r) for r in queries.op1_url_filters(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by_alias = [w for w in want if w[3] is None and w[4] == "block"]
    assert len(by_alias) > 3


def test_pages_of_unclosed_tags_are_read_once(spark):
    html = "<link " * 60_000 + "<meta " * 60_000 + '<link rel=canonical href="http://x.net/es/">'
    pages = spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")
    began = time.monotonic()
    assert [r.verdict for r in urlfilter.judge(pages).collect()] == ["block"]
    assert time.monotonic() - began < 60


def test_hot_ids_and_texts_are_numbered_without_gaps(spark):
    rows = [(None, f"t{i % 50}") for i in range(400)] + [(7, f"s{i}") for i in range(400)] + [(8, "same")] * 400 + [(i, "x") for i in range(100, 200)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for key in (None, 7, 8):
        assert len({(r.shard, r.grown_shard) for r in got if r.doc_id == key}) == 1


def test_running_starts_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else int(rng.integers(0, 40)), f"r{rng.integers(0, 200)}", int(rng.integers(1, 9))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, root string, n long").repartition(4)
    got = common.running_start(df, "doc_id", ["root"], "n", "start", per_range=90).collect()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n for r in ordered)])[:-1].tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0, r.root) for r in ordered]
    assert keys == sorted(keys)


@pytest.mark.parametrize("most", [15, 10**9])
def test_blocks_of_items_are_dropped_and_found_alike(spark, corpus, monkeypatch, most):
    items = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5}") for i in range(20)] + [(99, None)], "item_id long, text string")
    monkeypatch.setattr(decontam, "PASS_SHINGLES", most)
    kept = decontam.drop_contaminated(corpus, items)
    assert kept.columns == corpus.columns
    hit = {r.text for r in corpus.collect() if r.text and any(f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5}" in r.text for i in range(20))}
    assert hit and sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == sorted((r.doc_id, r.text) for r in corpus.collect() if r.text and r.doc_id is not None and r.text not in hit)


def plain_probability(raw, net):
    """Every window, chunk and filter in loops."""
    data = list(raw or b"")
    data += [0] * max(qualityclf.WIDTH - len(data), qualityclf.WIDTH - 1)
    windows = len(data) - qualityclf.WIDTH + 1
    response = [[sum(net.filters[f, k, data[i + k]] for k in range(qualityclf.WIDTH)) for f in range(qualityclf.FILTERS)] for i in range(windows)]
    half, acts = qualityclf.CHUNK // 2, []
    for start in range(0, windows, half):
        chunk = response[start : start + qualityclf.CHUNK]
        acts.append([math.tanh(max(r[f] for r in chunk) + net.bias[f]) for f in range(qualityclf.FILTERS)])
    mean = [sum(a[f] for a in acts) / len(acts) for f in range(qualityclf.FILTERS)]
    most = [max(a[f] for a in acts) for f in range(qualityclf.FILTERS)]
    z = sum(x * w for x, w in zip([*mean, *most, 1.0], net.out))
    return 1 / (1 + math.exp(-z))


def test_network_is_the_plain_convolution():
    rng = np.random.default_rng(1)
    net = qualityclf.Network(rng.normal(0, 0.4, (qualityclf.FILTERS, qualityclf.WIDTH, 256)), rng.normal(0, 0.2, qualityclf.FILTERS), rng.normal(0, 1, 2 * qualityclf.FILTERS + 1))
    for n in (0, 1, 3, 4, 255, 256, 257, 511, 512, 515, 600, 1300):
        raw = bytes(rng.integers(0, 256, n).tolist())
        assert qualityclf.probability(raw, net, net.tables()) == pytest.approx(plain_probability(raw, net), abs=1e-4), n


def test_fit_sees_all_of_a_long_text():
    rng = np.random.default_rng(5)
    good = [bytes(rng.integers(97, 123, 30_000).tolist()) for _ in range(12)]
    bad = [g[:29_000] + b"#" * 1000 for g in good]  # what tells them apart stands at the very end
    net = qualityclf.fit([x for pair in zip(good, bad) for x in pair], [1, 0] * 12, epochs=60)
    tables = net.tables()
    assert min(qualityclf.probability(g, net, tables) for g in good) > max(qualityclf.probability(b, net, tables) for b in bad) + 0.05


def test_winning_windows_do_not_depend_on_blocks():
    rng = np.random.default_rng(6)
    net = qualityclf.Network(rng.normal(0, 0.4, (qualityclf.FILTERS, qualityclf.WIDTH, 256)), np.zeros(qualityclf.FILTERS), np.zeros(2 * qualityclf.FILTERS + 1))
    x = qualityclf.pad(bytes(rng.integers(0, 256, 5000).tolist()))
    whole, parts = qualityclf.winners(x, net.tables()), qualityclf.winners(x, net.tables(), block=qualityclf.CHUNK)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_sample_in_memory_and_from_its_table_is_the_same(spark):
    rows = spark.createDataFrame([(i, i % 2, (i * 7919) % 101, bytes([i]) * i) for i in range(60)], "doc_id long, y int, h long, raw binary")
    assert list(qualityclf.Sample(rows)) == list(qualityclf.Sample(rows, most=0)) and len(list(qualityclf.Sample(rows))) == 60


def test_kept_rows_are_whole(spark, corpus):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 20)], "doc_id long, quality int, toxic int")
    kept = qualityclf.keep_good(corpus, labels, threshold=0.0)
    assert kept.columns == corpus.columns and kept.count() == corpus.count()
    assert qualityclf.keep_good(corpus, labels, threshold=1.1).count() == 0
    assert kept.select(F.sum("fp")).first()[0] == corpus.select(F.sum("fp")).first()[0]
