import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.llm import packing, tokenstore
from provspark.llm.common import scratch_path
from provspark.llm.tokens import Encoder, _load

public = pytest.importorskip("public_tokenizers")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name, text):
    return _load(public.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sdé́ \x1c .,-1Aβ漢<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_pieces_encode_as_the_whole(name, texts):
    got = Encoder(public.path(name)).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(name, t) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_special_strings_and_white_space_encode_as_the_library_does(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path(name))
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b", "x <|endoftext|>", "two  spaces", " lead", "tail ", "\nline", "a\n\nb", "a \n b", "tab\there\r\nis", "\u2003wide\u00a0space", "", None]
    texts += ["Ünder ßtraße. ÉCOLE*** naïve,", "don't YOU'LL 12,5 x9", "ab" * 200 + "!?", "İstanbul ﬁ x\u0301y", "\x1cctl\x00 nul", "漢字 かな"]
    got = Encoder(public.path(name)).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_encoder_forgets_and_encodes_alike(name):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéÀ"), rng.integers(1, 7))) + str(rng.choice(["", ".", "***", "'s"])) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(30)]
    Encoder._shared.pop(public.path(name), None)
    small = Encoder(public.path(name), limit=500)
    got = [x for t in texts for x in small.encode([t])]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(name, t) for t in texts]
    assert len(small.start) < 5000
    Encoder._shared.pop(public.path(name))


def test_changed_manifest_is_noticed(spark, corpus):
    path = scratch_path(spark, "store")
    tokenstore.write_store(corpus, path, public.path(FILES[0]))
    rows = [r.asDict() | {"n_tokens": r.n_tokens + 1} for r in spark.read.parquet(f"{path}/manifest").collect()]
    spark.createDataFrame(rows, spark.read.parquet(f"{path}/manifest").schema).write.mode("append").parquet(f"{path}/manifest")
    assert tokenstore.check_manifest(spark, path).count() > 0
    with pytest.raises(Exception, match="manifest"):
        tokenstore.read_store(spark, path, public.path(FILES[0]))


def test_store_round_trip(spark, corpus):
    path = scratch_path(spark, "store")
    tokenstore.write_store(corpus, path, public.path(FILES[0]))
    got = sorted(spark_rows(tokenstore.read_store(spark, path, public.path(FILES[0]), ids=True)), key=lambda r: r["start"])
    want = sorted(([r.doc_id, [*plain(FILES[0], r.text), 0]] for r in corpus.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g["doc_id"] for g in got] == [w[0] for w in want]
    start = 0
    for g in got:
        ids = np.frombuffer(g["ids"], "<u4")
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(g["ids"]))
        start += len(ids)
    assert sorted(tuple(np.frombuffer(g["ids"], "<u4").tolist()) for g in got) == sorted(tuple(w[1]) for w in want)
    assert tokenstore.check_manifest(spark, path).count() == 0
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    digests = tokenstore.read_store(spark, path, public.path(FILES[0]))
    assert {(r.start, r.ids_crc32) for r in digests.collect()} == {(g["start"], g["ids_crc32"]) for g in got}


def spark_rows(df):
    return [r.asDict() for r in df.collect()]


def test_empty_store(spark, empty):
    path = scratch_path(spark, "store")
    tokenstore.write_store(empty, path, public.path(FILES[0]))
    assert tokenstore.read_store(spark, path, public.path(FILES[0])).count() == 0


def test_damaged_chunk_is_noticed(spark, corpus):
    path = scratch_path(spark, "store")
    tokenstore.write_store(corpus, path, public.path(FILES[0]))
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    broken = [(r.hash, bytes(r.payload)[:-2] + b"\x07\x07") for r in chunks]
    spark.createDataFrame(broken, "hash binary, payload binary").write.parquet(f"{path}/broken")
    spark.sparkContext._jvm.java.io.File(path.removeprefix("file:") + "/chunks").renameTo(spark.sparkContext._jvm.java.io.File(path.removeprefix("file:") + "/old"))
    spark.sparkContext._jvm.java.io.File(path.removeprefix("file:") + "/broken").renameTo(spark.sparkContext._jvm.java.io.File(path.removeprefix("file:") + "/chunks"))
    with pytest.raises(Exception, match="damaged"):
        tokenstore.read_store(spark, path, public.path(FILES[0])).collect()


def test_chunks_resist_shifts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")

    def cut(x):
        ends = tokenstore.cut_points(x)
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    whole, moved = cut(ids), cut(np.concatenate([ids[:37], ids]))
    assert len(whole & moved) > 0.9 * len(whole)
    ends = tokenstore.cut_points(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= tokenstore.MOST


@given(st.binary(max_size=200), st.binary(max_size=200))
def test_joined_crc(a, b):
    assert tokenstore.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("windows", [1, 4, 64])
def test_packing_keeps_every_id_once(corpus, windows):
    rows = packing.pack(corpus, capacity=256, open_windows=windows, with_ids=True).collect()
    want = sorted(tuple([*plain(FILES[1], r.text), 1]) for r in corpus.collect())
    by_doc = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
    got = []
    for (_, total), pieces in by_doc.items():
        starts = sorted({s for s, _ in pieces})
        copies = sum(s == 0 for s, _ in pieces)
        assert len(pieces) == copies * len(starts)
        if copies == 1:
            assert sum(len(i) for _, i in pieces) == total
            got.append(tuple(x for _, i in sorted(pieces) for x in i))
    assert set(got) <= set(want) and sum(r.length for r in rows) == sum(map(len, want))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_windows_take_the_best_fit_and_emit_the_fullest():
    w = packing.Windows(10, 2)
    assert w.place("a", 6) is None and w.place("b", 3) is None  # b joins a: 1 left
    assert w.place("c", 5) is None
    assert w.place("d", 7) == ["a", "b"]
    assert sorted(w.rest()) == [["c"], ["d"]]
    assert w.place("e", 5) == ["c", "e"]
