"""Operators against plain versions on hand-made cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from provspark.llm import decontam, linededup, lmscore, qualityclf, qualityrules, queries, sharding, urlfilter


def words(text, lower=True):
    raw = (text or "").encode()
    return [w.decode() for w in (raw.lower() if lower else raw).split()]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# url filters


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, a) for h, p, a in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["http://a.com/x", "https://COM/", "http://com", "http://example.com/en/1?x=http://net/es/", "https://WWW.Example.com/en/", "http://m.example.com/en/#a", "http://x.net/es/q", "http://x.net/fr", "http://x.net/fr/", "http://xnet/fr/", "http://org/?a/b", "nourl", "", None, "://net/es/", "http://é.NET/es/", "a://b://com/", "http://x.net:80/es/", "http://net/ES/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, action = plain_rule(u)
        assert got[i] == (host, path, rule, action or "allow"), u


def test_aliases_take_over_blocks(spark):
    link = '<html><LINK href="{}" rel="canonical"></html>'
    pages = [
        (1, "http://a.org/one", link.format("http://b.net/es/x")),  # alias of a blocked url
        (2, "http://a.org/two", '<meta http-equiv="refresh" content="0; url=/one">'),  # alias of an alias
        (3, "http://b.com/three", link.format("http://a.org/one")),  # explicit allow keeps itself
        (4, "http://c.org/four", link.format("http://b.com/free")),  # alias of an allowed url
        (5, "http://A.org/one#frag", ""),  # the same resource as 1
        (6, "http://d.org/six", "<p>canonical</p>"),
        (7, "http://e.org/seven", None),
        (7, "http://e.org/seven", None),
    ]
    redirects = spark.createDataFrame([("http://e.org/seven", "http://a.org/two"), (None, "x"), ("http://q.org", "http://q.org")], "src string, dst string")
    got = rows_of(urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects), "page_id", "verdict")
    assert got == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "block"), (6, "allow"), (7, "block"), (7, "block")]


def test_relative_links(spark):
    base = "http://h.org/a/b?q#f"
    cases = {"/x": "http://h.org/x", "y": "http://h.org/a/y", "//o.net/es/": "http://o.net/es/", "http://z.com/?a=1&amp;b": "http://z.com/?a=1&b", "?p": "http://h.org/a/?p"}
    pages = spark.createDataFrame([(i, base, f"<link rel=canonical href='{c}'>") for i, c in enumerate(cases)], "page_id long, url string, html string")
    assert {r.dst for r in urlfilter.alias_edges(pages).collect()} == set(cases.values())


def test_no_pages(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# sharding


def test_shards(spark, corpus, empty):
    rows = sharding.assign(corpus).collect()
    assert len(rows) == corpus.count()
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    texts = {(r.doc_id, r.text) for r in corpus.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts}
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in rows)
    again = sharding.assign(corpus.repartition(7)).collect()
    assert {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows} == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in again}
    assert sharding.assign(empty).count() == 0


def test_weighted_shards(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    n = Counter(r.shard for r in sharding.assign(docs, (1.0, 3.0, 0.0), (1.0, 3.0, 0.0, 4.0)).collect())
    assert n[2] == 0 and abs(n[1] / n[0] - 3) < 0.2
    moved = sharding.assign(docs, (1.0, 3.0, 0.0), (1.0, 3.0, 0.0, 4.0)).where("shard <> grown_shard")
    assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {3} and abs(moved.count() / 20_000 - 0.5) < 0.02


def test_written_shards(spark, corpus, tmp_path):
    sharding.write_shards(corpus.select("doc_id", "text"), f"{tmp_path}/s", files=2)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == corpus.count() and set(back.columns) == {"doc_id", "text", "shard"}


# quality rules


def plain_base(text):
    ws = words(text, lower=False)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(corpus):
    for r in corpus.collect():
        raw = None if r.text is None else r.text.encode()
        assert qualityrules.base_counts(raw) == plain_base(r.text)
    for t in ("a b c a b c", "a a a a", "a b a b", "x\n\nx\n \n", "\u00a0 \u3000x", "|$|"):
        assert qualityrules.base_counts(t.encode()) == plain_base(t), t


def test_log_ratio_matches_plain_version(spark, corpus, empty):
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0), (9, 1, 0), (16, 1, 1), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    raw, target = Counter(), Counter()
    bucket = lambda t: [(ord(a) * 66931 + ord(b) * 1031 + ord(c)) % qualityrules.BUCKETS for a, b, c in zip(t, t[1:], t[2:])]
    rows = corpus.collect()
    for r in rows:
        raw.update(bucket(r.text or ""))
        if r.doc_id in (1, 9):
            target.update(bucket(r.text))
    n, m = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] + m / n) / (m + m / n * qualityrules.BUCKETS)) - math.log((raw[b] + 1) / (n + qualityrules.BUCKETS))
    got = qualityrules.judge(corpus, labels).collect()
    assert len(got) == len(rows)
    plain = {(r.doc_id, plain_base(r.text)): r.text or "" for r in rows}
    for g in got:
        text = plain[g.doc_id, (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words)]
        b = bucket(text)
        assert g.mean_ratio == pytest.approx(sum(map(ratio, b)) / len(b) if b else 0.0, abs=1e-9)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert g.kept == (not g.base_failed and g.mean_ratio >= qualityrules.LEAST)
    assert qualityrules.judge(empty, labels).count() == 0
    assert all(r.mean_ratio == 0 for r in qualityrules.judge(corpus, labels.limit(0)).collect())


def test_rules_count_every_trusted_document(spark):
    """None is left out, however many there are; rows without an id count as raw text only."""
    n = 20_050
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    ids = qualityrules.trusted_ids(labels)
    assert ids.count() == n and qualityrules.trusted_ids(labels, 7).count() == 7
    docs = spark.range(-3, n).selectExpr("if(id = -1, null, id) as doc_id", "'abc' as text")
    assert [tuple(r)[1:] for r in qualityrules.counts(docs, ids).collect()] == [(n + 3, n)]


# line dedup


def plain_dedup(rows, long_words=linededup.LONG_WORDS):
    """The rule in plain loops: two neighbouring lines with words, or one long line, go if an earlier place has them."""
    first, removed = {}, {}
    for doc in sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = doc[1].split("\n")
        solid = [i for i, x in enumerate(lines) if words(x)]
        for a, b in sorted([*zip(solid, solid[1:]), *((i, i) for i in solid if len(words(lines[i])) >= long_words)]):
            where, end = first.setdefault(tuple(lines[a : b + 1]), (doc, b))
            if where != doc or a > end:
                removed.setdefault(doc, set()).update(range(a, b + 1))
    out = []
    for d, t in rows:
        cut = removed.get((d, t), set())
        out.append((d, t if not cut else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut), len(cut)))
    return out, removed


def test_line_dedup_matches_plain_version(spark, corpus):
    rng = np.random.default_rng(2)
    lines = [f"line {i} of it" for i in range(40)]
    block = lines[:9]
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    for d in range(100, 130):
        own = [f"own {d} {j}" for j in range(int(rng.integers(0, 6)))]
        a = int(rng.integers(0, 5))
        rows.append((d, "\n".join([*own[:2], *block[a : a + int(rng.integers(2, 9))], *own[2:], *rng.choice(lines, 3).tolist(), ""])))
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, n_chars long, h string").repartition(3)
    got = linededup.without_repeats(df, counted=True)
    assert got.columns == ["doc_id", "text", "n_chars", "h", "removed_lines"]
    want, _ = plain_dedup(rows)
    assert rows_of(got, "doc_id", "text", "removed_lines") == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 50
    texts = {r.doc_id: r.text for r in got.collect()}
    passage = "second line of the passage here"
    assert passage in texts[9] and passage not in texts[10] and "shared7" in texts[11] and "shared7" not in texts[12]
    assert all(r.n_chars == len(r.text) for r in got.where("removed_lines > 0").collect())


def test_line_dedup_of_nothing(empty):
    got = linededup.without_repeats(empty)
    assert got.count() == 0 and got.columns == empty.columns


# language model


def test_lm_counts_and_scores(spark, corpus, empty):
    got = lmscore.score(corpus, frequent=20).collect()
    rows = corpus.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for r in rows if not held(r.doc_id) for w in [*words(r.text), "\n"])
    n, v = sum(count.values()), len(count)
    want = []
    for r in rows:
        ws = [*words(r.text), "\n"]
        want.append((r.doc_id, held(r.doc_id), len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)))
    assert sorted(((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got), key=repr) == sorted(want, key=repr)
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)
    every = {(g.doc_id, g.n_tokens): g.score for g in lmscore.score(corpus, frequent=100_000).collect()}
    assert all(every[g.doc_id, g.n_tokens] == pytest.approx(g.score, abs=1e-6) for g in got)
    assert lmscore.score(empty).count() == 0


def plain_code(word):
    """A word's code by scalar arithmetic."""
    mask = 2**64 - 1
    if word == "\n":
        return int(lmscore.END)
    raw = word.encode()
    h = sum(int(lmscore._TABLE[min(i, 63) * 256 + b]) for i, b in enumerate(raw)) * int(lmscore._SALTS[0]) & mask
    if len(raw) > 64:
        h = xxhash.xxh64_intdigest(raw)
    h ^= h >> 32
    last = sum((raw[-1 - k] if k < len(raw) else 0) << 8 * (2 - k) for k in range(3))
    last = (last + 1) * int(lmscore._SALTS[1]) % 2**64 >> 40
    return h >> 10 << 10 | (last % (lmscore.ENDINGS - 1) + 1)


def plain_score(model, floor, count, ws):
    """log10 probability of a text, token by token, every class and group summed."""
    salts, mask, total = [int(x) for x in lmscore._SALTS], 2**64 - 1, 0.0
    codes = [0, 0, 0, *map(plain_code, ws)]
    for i, w in enumerate(ws):
        three, two, one = codes[i : i + 3]
        hashed = [(k + t + 1) * salts[t] & mask for t, k in enumerate((one, two, three, one * salts[3] + two & mask))]
        e = codes[i + 3] % lmscore.ENDINGS
        c, g = int(model.class_of[e]), int(model.group_of[e])
        for factor, bias, rows, own in (
            (model.first, 0, [(k >> 52) + t * lmscore.BUCKETS for t, k in enumerate(hashed)], c),
            (model.second, c, [(((k ^ (c + 1) * salts[2] & mask) * salts[1] & mask) >> 50) + t * 4 * lmscore.BUCKETS for t, k in enumerate(hashed)], g),
        ):
            z = factor.bias[bias].astype(float) + sum(factor.weights[r].astype(float) for r in rows)
            total += (z[own] - math.log(np.exp(z).sum())) / math.log(10)
        total += math.log10(count[w] + 1) - floor[c, g]
    return total


def test_lm_score_matches_brute_force(spark, corpus):
    docs = corpus.where("length(text) < 20000 or text is null")
    train = lmscore.coded(docs).where("not held")
    counts = lmscore.word_counts(train)
    model, floor, total, distinct = lmscore.learn(train, counts)
    rows = docs.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for r in rows if not held(r.doc_id) for w in [*words(r.text), "\n"])
    assert (total, distinct) == (sum(count.values()), len(count))
    assert {r.word: r.c for r in counts.collect()} == {int(np.uint64(plain_code(w)).view(np.int64)): c for w, c in count.items()}
    got = {(r.doc_id, r.n_tokens): r.score for r in lmscore.score(docs, frequent=30).collect()}
    for r in rows:
        ws = [*words(r.text), "\n"]
        assert got[r.doc_id, len(ws)] == pytest.approx(plain_score(model, floor, count, ws), abs=1e-3 * len(ws)), r.doc_id
    # the shares of a group's words and of one not seen are all of it
    shares = Counter()
    for w, c in count.items():
        e = plain_code(w) % lmscore.ENDINGS
        shares[int(model.class_of[e]), int(model.group_of[e])] += c + 1
    assert all(10 ** floor[k] == pytest.approx(n + (k != (0, 0))) for k, n in shares.items())  # nothing else can be the end


def lm_blocks(seed=1, n=4):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(["and", "bird", "cold", "door", "even"], 300, p=[0.4, 0.3, 0.1, 0.1, 0.1])) for _ in range(n)]
    return [lmscore.Block.of(pa.array(texts[i : i + 2])) for i in range(0, n, 2)]


def test_blocks_keep_their_texts():
    texts = pa.array([None, "", " a  B a\t", "x" * 100, "y", "\x0b\x0c", "é é ß", "a b"])
    for start, size in ((0, 8), (2, 4), (7, 1), (0, 1), (3, 0)):
        part = texts.slice(start, size)
        block = lmscore.Block.unpacked(*lmscore.Block.of(part).packed())
        want = [plain_code(w) for t in part.to_pylist() for w in [*words(t), "\n"]]
        assert block.words[block.ids].tolist() == want
        assert block.sizes.tolist() == [len(words(t)) + 1 for t in part.to_pylist()]


def test_texts_together_are_as_apart():
    texts = ["a b c d e f", "a", None, "b a d", "c c"]
    together = lmscore.Block.of(pa.array(texts)).rows()
    apart = [lmscore.Block.of(pa.array([t], pa.string())).rows() for t in texts]
    for t, rows in enumerate(together):
        assert rows.tolist() == [x for a in apart for x in a[t].tolist()]


def test_updates_follow_the_gradient():
    blocks = lm_blocks()
    single = sum(np.bincount(lmscore.endings(b.words)[b.ids], minlength=lmscore.ENDINGS) for b in blocks)
    beside = np.random.default_rng(2).random((lmscore.ENDINGS, lmscore.ENDINGS)) * np.outer(single, single)
    class_of, group_of = lmscore.learn_classes(beside, single)
    seen = [np.zeros(s, np.int64) for s in lmscore.SHAPES]
    for b in blocks:
        lmscore.see(b, class_of, group_of, *seen)
    tokens = sum(len(b.ids) for b in blocks)
    assert [int(t.sum()) for t in seen] == [lmscore.TEMPLATES * tokens] * 2
    model = lmscore.start(seen, single, class_of, group_of)
    likelihood = [sum(model.log_p(b).sum() for b in blocks)]
    for k in range(3):
        expected = [np.zeros(s, np.int64) for s in lmscore.SHAPES]
        for i, b in enumerate(blocks):
            lmscore.expect(b, model, *expected, seed=10 * k + i)
        assert [int(t.sum()) for t in expected] == [lmscore.TEMPLATES * tokens] * 2
        model.first.update(seen[0], expected[0])
        model.second.update(seen[1], expected[1])
        likelihood.append(sum(model.log_p(b).sum() for b in blocks))
    assert likelihood[-1] > likelihood[0]


def test_draws_follow_the_softmax():
    rng = np.random.default_rng(0)
    z = np.tile(rng.normal(0, 1.5, 8).astype(np.float32), (40_000, 1))
    p = np.exp(z[0]) / np.exp(z[0]).sum()
    assert np.allclose(lmscore.log_share(z.copy(), np.full(len(z), 3))[0], np.log(p[3]), atol=1e-5)
    found = np.bincount(lmscore.drawn(z.copy(), rng.random(len(z), np.float32)), minlength=8) / len(z)
    assert np.abs(found - p).max() < 0.01


def test_model_beats_the_base_on_held_out_texts(spark):
    got = lmscore.score(queries.table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").toPandas()
    assert got.score.sum() / got.base_score.sum() < 0.97


# decontamination


def plain_hits(docs, items):
    out = []
    for i, item in items:
        ws = words(item)
        if not ws:
            continue
        k = min(5, len(ws))
        q = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}
        for d, text in docs:
            have = words(text)
            n = len(q & {tuple(have[j : j + k]) for j in range(len(have) - k + 1)})
            if n >= 0.8 * len(q) - 1e-9:
                out.append((d, i, len(q), n))
    return sorted(out, key=repr)


def test_contained_items(spark, corpus, empty):
    base = " ".join(f"w{i}" for i in range(120))
    items = [(1, base), (2, " ".join(f"W{i}" for i in range(10, 40))), (3, "one"), (4, "two one"), (5, None), (6, "  "), (7, " ".join(f"w{i}" for i in range(30)) + " z1 z2"), (8, " ".join(f"w{i}" for i in range(15)) + " z1 z2 z3 z4 z5"), (9, "alpha beta first line of the passage here"), (2, "word word word word word")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontam.contained_items(corpus, table), "doc_id", "item_id", "n_shingles", "n_shared")
    assert got == plain_hits([(r.doc_id, r.text) for r in corpus.collect()], items) and len(got) > 8
    assert decontam.contained_items(empty, table).count() == 0 and decontam.contained_items(corpus, table.limit(0)).count() == 0
    assert decontam.drop_contaminated(corpus, table).columns == corpus.columns


def test_items_in_blocks(spark, corpus, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5}") for i in range(20)], "item_id long, text string")
    whole = rows_of(decontam.contained_items(corpus, items), "doc_id", "item_id", "n_shared")
    monkeypatch.setattr(decontam, "PASS_SHINGLES", 20)
    assert rows_of(decontam.contained_items(corpus, items), "doc_id", "item_id", "n_shared") == whole and whole


# classifier


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    net = qualityclf.train(docs, labels, per_class=250)
    got = qualityclf.score(docs, net).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.93 and (bad.predicted == 0).mean() > 0.93


def test_classifier_gradients():
    rng = np.random.default_rng(0)
    net = qualityclf.Network(rng.normal(0, 0.3, (qualityclf.FILTERS, qualityclf.WIDTH, 256)), rng.normal(0, 0.1, qualityclf.FILTERS), rng.normal(0, 1, 2 * qualityclf.FILTERS + 1))
    x = qualityclf.pad(bytes(rng.integers(97, 110, 1500).tolist()))
    grads = [np.zeros_like(v) for v in (net.filters, net.bias, net.out)]
    qualityclf._backward(x, 1.0, 1.0, net, net.tables(), grads)
    loss = lambda: -math.log(qualityclf.probability(bytes(x[: 1500]), net, net.tables()))
    for values, grad in zip((net.filters, net.bias, net.out), grads):
        for at in [np.unravel_index(i, grad.shape) for i in np.argsort(-np.abs(grad).ravel())[:3]]:
            was, step = values[at], 1e-3
            values[at] = was + step
            up = loss()
            values[at] = was - step
            down = loss()
            values[at] = was
            assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.1, abs=2e-3)


def test_classifier_covers_whole_texts(monkeypatch):
    net = qualityclf.fit([b"aaaa " * 50, b"#### " * 50] * 4, [1, 0] * 4, epochs=4)
    tables = net.tables()
    long = b"abcd " * 20_000
    whole = qualityclf.features(long, tables, net.bias)
    assert np.allclose(whole, qualityclf.features(long, tables, net.bias, block=qualityclf.CHUNK * 40), atol=1e-5)
    assert not np.allclose(whole, qualityclf.features(long + b"####", tables, net.bias))
    for t in (None, b"", b"a", b"ab", b"abc"):
        assert 0 < qualityclf.probability(t, net, tables) < 1


def test_classifier_of_few_rows(spark, corpus, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = qualityclf.score(corpus, qualityclf.train(corpus, none)).collect()
    assert {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert qualityclf.score(empty, qualityclf.train(corpus, one)).count() == 0
    held = {r.doc_id: r.held_out for r in got}
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items())
