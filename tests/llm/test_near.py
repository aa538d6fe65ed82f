"""Near copies that SimHash at two bits does not join."""

import numpy as np
from test_simhash import plain_fingerprint

import corpus_pipeline
from provspark.llm import simhash
from provspark.llm.common import materialize


def shingled(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jaccard(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def test_near_copies_at_five_words_go(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(12):
        base = [f"c{c}w{k}" for k in range(200)]
        rows.append((len(rows), " ".join(base)))
        for change in (1, 2, 3, 4, 12, 25):
            words = list(base)
            for at in rng.choice(200, change, replace=False):
                words[at] = f"new{len(rows)}x{at}"
            rows.append((len(rows), " ".join(words)))
    label = list(range(len(rows)))
    fps, apart = [plain_fingerprint(t) for _, t in rows], 0
    for i in range(len(rows)):
        for j in range(i):
            similar, close = jaccard(rows[i][1], rows[j][1]) >= 0.8, (fps[i] ^ fps[j]).bit_count() <= 2
            apart += similar and not close
            if (similar or close) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {i for i in range(len(rows)) if label[i] == i} and apart > 20 and len(got) < 40


def test_near_copies_of_nothing(empty):
    assert simhash.keep_near(empty).count() == 0


def test_parities_never_count_too_many():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 400))).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 2**63, int(rng.integers(0, 200))).astype(np.uint64)]))
        x, y = simhash.parities(a), simhash.parities(b)
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(simhash.folded(x, size) ^ simhash.folded(y, size)).sum())
        only = len(np.setxor1d(a, b))
        assert apart <= only and (apart >= 0.8 * only or only > 0.2 * len(a))  # close sets are told apart well


def test_large_groups_of_near_copies_of_one_original(spark):
    """Copies of one text with edits of their own: most are near the original, few near each other."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for d in range(1, 150):
        own = list(base)
        for k in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            own[k] = f"x{rng.integers(0, 6)}"
        rows.append((d, " ".join(own)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(146)} for d, t in rows}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {find(i) for i in range(len(rows))}
    kept = {r.doc_id for r in simhash.keep_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept <= want and len(want) > 5  # SimHash may join a few more
    assert len(want - kept) <= 2


def test_sets_and_anchors_are_never_broadcast(spark):
    """Their statistics are far below their size: a small file can take all of the driver's memory."""
    rows = [(d, " ".join(f"w{i}" for i in range(40) if i != d)) for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = materialize(simhash._signed(docs, 5), "test-signed")
    close = simhash.links(signed.select("fp").distinct())
    found = simhash.near_links(docs, signed, materialize(close, "test-links"), 5, 0.5)
    for made, joins in ((close, 1), (found, 2)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= joins
    assert found.count() > 0
