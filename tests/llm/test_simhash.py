import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provspark.llm import simhash
from provspark.llm.common import materialize
from provspark.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, fps[i], min(ids, default=None)))
    return out


def test_groups_match_plain_version(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(corpus).collect()]
    assert sorted(got, key=repr) == sorted(plain_groups(rows), key=repr)


def test_empty_table(empty):
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns


def test_keep_one_goes_by_id_and_text(spark, corpus):
    kept = [r.doc_id for r in simhash.keep_one(corpus).collect()]
    assert 1 in kept and 2 not in kept and None not in kept and 4 in kept and 5 not in kept and kept.count(13) == 1
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "quite another text here"), (None, "a b c d"), (None, "one without an id"), (3, "one without an id")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d"), (2, "quite another text here"), (3, "one without an id")]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2, unique=True))
def test_two_words_within_two_bits_meet_at_an_anchor(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    met = False
    for k in (0, 1):
        x, y = (np.array([v >> 32 * k & 0xFFFFFFFF], np.uint64) for v in (a, b))
        met |= bool((simhash.anchors_within(y)[1] == simhash.home_anchor(x)[0]).any())
    assert met


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(12):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)))
    fps = sorted(fps)
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert {(r.a, r.b) for r in simhash.links(df).collect()} == want and len(want) > 100


def test_anchors_of_a_small_table_are_not_broadcast(spark, tmp_path):
    """35 anchors a fingerprint would go to the driver from a file that is below the threshold."""
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    made = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_rows_of_copies_are_not_broadcast(spark, monkeypatch):
    """Their ids and fingerprints take a byte or two a row: a file below the threshold may hold millions."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and "), F.col("id") % 7).alias("text"))
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr(simhash, "materialize", kept)
    made = simhash.simhash_groups(docs)
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in x for x in plans) and any("SortMergeJoin" in x for x in plans)
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in made.collect())
    first = {(f, c) for _, f, c in plain_groups([(i, f"some words and {i}") for i in range(7)])}
    assert len(got) == 3000 and {(f, c) for _, f, c in got} == first


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(500, 900)] + [(7, 3), (1, 1), (None, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[899] == got[7] == 3 and 2 not in got
