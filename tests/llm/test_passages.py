"""Repeated passages and copies, whatever their lines and wherever they stand, without the operator's own rule."""

import numpy as np
from test_operators import plain_dedup, rows_of, words

from provspark.llm import linededup


def line(name, n):
    return " ".join(f"{name}w{k}" for k in range(n))


def every_passage(rows, need=linededup.LONG_WORDS):
    """Lines of every stretch of ``need`` words that stands at an earlier place, by document, stretches of any length."""
    first, gone = {}, {}
    for d, t in sorted(set(rows)):
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                part = tuple(lines[a:b])
                if not (words(part[0]) and words(part[-1]) and sum(len(words(x)) for x in part) >= need):
                    continue
                d0, b0 = first.setdefault(part, (d, b))
                if d0 != d or a >= b0:
                    gone.setdefault(d, set()).update(range(a, b))
    return gone


def mixed_rows():
    rng = np.random.default_rng(5)
    rows = [(1, f"{line('a', 30)}\n{line('b', 30)}"), (2, f"own two\n{line('a', 30)}\n{line('b', 30)}\nend two")]
    paragraphs = "\n\n".join(line(f"p{k}", 20) for k in range(6))
    rows += [(3, paragraphs), (4, f"own four\n\n\n{paragraphs}\n"), (5, "\n".join(["ten words of one line that comes again and again"] * 12))]
    pool = [line(f"q{k}", int(rng.integers(3, 40))) for k in range(12)] + ["", " "]
    for d in range(10, 60):
        a, n = int(rng.integers(0, 9)), int(rng.integers(1, 6))
        rows.append((d, "\n".join([f"own {d}", *pool[a : a + n], *rng.choice(pool, 3).tolist(), f"end {d}"])))
    return rows


def test_no_passage_comes_twice(spark):
    rows = mixed_rows()
    got = {r.doc_id: r.text.split("\n") for r in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    gone = every_passage(rows)
    assert sum(map(len, gone.values())) > 60
    for d, t in rows:
        lines = t.split("\n")
        allowed = [x for i, x in enumerate(lines) if i not in gone.get(d, ()) and words(x)]
        kept = [x for x in got[d] if words(x)]
        assert all(kept.count(x) <= allowed.count(x) for x in set(kept)), d
    assert got[2] == ["own two", "end two"] and not any("p3w1" in x for x in got[4])
    assert {x for _, t in rows for x in t.split("\n") if words(x)} == {x for t in got.values() for x in t if words(x)}


def test_the_cuts_do_not_show(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted(plain_dedup(rows)[0], key=repr)
    for modulus in (1, 2, 3, 50):
        assert rows_of(linededup.without_repeats(df, modulus=modulus, counted=True), "doc_id", "text", "removed_lines") == want


def test_planted_passages_and_copies_go_and_clean_lines_stay(spark):
    rng = np.random.default_rng(9)
    fresh = iter(range(10**6))
    own = lambda n: [line(f"o{next(fresh)}x", int(rng.integers(4, 30))) for _ in range(n)]
    passages = [[line(f"s{k}l{j}", 60 // n + 1) for j in range(n)] for k, n in enumerate((1, 2, 3, 5, 8, 13))]
    rows, planted = [], []
    for d in range(120):
        body = own(int(rng.integers(2, 25)))
        if d % 2:
            k = int(rng.integers(0, len(passages)))
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = passages[k]
            planted.append((d, k))
        rows.append((d, "\n".join(body)))
    copies = [(1000 + d, t) for d, t in rows[:40]] + [(2000 + d, f"{t}\n{own(1)[0]}") for d, t in rows[40:80]]
    got = {r.doc_id: r.text for r in linededup.without_repeats(spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(4)).collect()}
    for k, p in enumerate(passages):
        holders = [d for d, _ in rows if any(x in got[d].split("\n") for x in p)]
        assert holders == [d for d, j in planted if j == k][:1]
    for d, t in rows:
        assert [x for x in t.split("\n") if x.startswith("o")] == [x for x in got[d].split("\n") if x.startswith("o")]
    assert all(got[1000 + d] == "" for d in range(40))
    assert all(len(got[2000 + d].split("\n")) == 1 and got[2000 + d] for d in range(40, 80))


def test_a_document_of_very_many_lines(spark):
    text = "\n".join(f"line number {i} of it" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, f"{text}\nmore"), (3, "x\n" * 50_000)], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.removed_lines) for r in linededup.without_repeats(df, counted=True).where("doc_id > 1").collect()} == {2: ("more", 200_000), 3: ("x\nx\n", 49_998)}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b\nc d", 1, "p", "q", 9), (2, "a b\nc d\ne", 2, "p", "q", 9)], "doc_id long, text string, _id int, _th string, rm string, `odd.name` int")
    got = linededup.without_repeats(df, counted=True)
    assert got.columns == [*df.columns, "removed_lines"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b\nc d", 1, "p", "q", 9, 0), (2, "e", 2, "p", "q", 9, 2)]


def test_pipeline_leaves_no_passage(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, f"own {d} first\n" + "\n\n".join(line(f"p{k}", 30) for k in range(4)) + f"\nown {d} last") for d in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert sum("p1w3" in t for t in got.values()) == sum("p2w3" in t for t in got.values()) == 1 and set(got) == {1, 2, 3}
