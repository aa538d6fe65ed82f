"""Benchmark decontamination: size-partitioned MinHash containment, verified by exact shingle containment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import bounded_batches, each_text, materialize, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of the test items, about, that one pass over the documents carries (some 150 bytes each in a Python worker);
#: more items take more passes, one after the other.
PASS_SHINGLES = 1_000_000
_MASK = (1 << 64) - 1
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of ``width`` word hashes, order-sensitive."""
    n = len(word_hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = (out + word_hashes[k : k + n]) * _MULT
        out ^= out >> np.uint64(31)
    return _mix(out)


class WordHashes(dict):
    """Word -> hash, remembered; started anew when it holds too many words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Sketches:
    """Test items in partitions by size, each with its bottom-k MinHash sketch.

    An item has q distinct shingles; those of one partition have q in [2^j, 2^(j+1)). Containment of at least
    t leaves at most (1 - t) q shingles unshared, so the k = floor((1 - t) u) + 1 smallest hashes of an item, u
    the largest q of its partition, hold one that the document shares, whatever the document's length. A
    document is a candidate when it has one of them; small items have their whole shingle set sketched.
    """

    def __init__(self, items: list[tuple[int, bytes | None]], width: int = SHINGLE, threshold: float = THRESHOLD):
        self.threshold = threshold
        memo = WordHashes()
        sized: dict[tuple[int, int], list] = defaultdict(list)
        for ident, raw in items:
            words = words_of(raw)
            if words:
                w = min(width, len(words))
                q = shingles(words, w)
                hashes = np.unique(shingle_hashes(memo.of(words), w))
                sized[w, len(q).bit_length()].append((ident, frozenset(q), hashes))
        self.shingles: list[frozenset] = []
        self.ids: list[int] = []
        table: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for (w, _), group in sized.items():
            most = max(len(q) for _, q, _ in group)
            k = int((1 - threshold) * most + 1e-9) + 1
            for ident, q, hashes in group:
                for h in hashes[:k].tolist():
                    table[w][h].append(len(self.ids))
                self.ids.append(ident)
                self.shingles.append(q)
        self.tables = {w: ({h: tuple(v) for h, v in t.items()}, self._filter(t)) for w, t in table.items()}

    @staticmethod
    def _filter(table: dict) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[np.fromiter(table, np.uint64, len(table)) & np.uint64((1 << 20) - 1)] = True
        return bits

    def search(self, raw: bytes | None, memo: WordHashes) -> list[tuple[int, int, int]]:
        """(item, item's shingles, shared shingles) of all items contained in the text."""
        words = words_of(raw)
        if not words or not self.tables:
            return []
        hashed, found = memo.of(words), []
        for w, (table, bits) in self.tables.items():
            if len(words) < w:
                continue
            h = shingle_hashes(hashed, w)
            likely = h[bits[h & np.uint64((1 << 20) - 1)]]
            hits = {i for x in set(likely.tolist()) if x in table for i in table[x]}
            if hits:
                have = shingles(words, w)
                for i in hits:
                    q = self.shingles[i]
                    shared = len(q & have)
                    if shared >= self.threshold * len(q) - 1e-9:
                        found.append((self.ids[i], len(q), shared))
        return sorted(found)


def contained_items(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for every document and test item whose distinct
    word shingles are in the document to at least ``threshold``.

    ``docs(doc_id, text)``, ``items(item_id, text)``; A-Z is lower-cased, texts are used whole. An item of fewer
    words than ``width`` is one shingle of all its words, looked for at that width. Items with null or empty
    text, and documents with null or empty text, match nothing. Repeated rows are reported once a row. The items
    are a stated query set: they go to the executors in blocks of bounded size, each a pass over the documents.
    """
    out, found = None, None
    for part in _item_blocks(items):
        if found is not None:  # there is another block: the one before is searched now, and its sketches go
            out, found = _joined(out, materialize(found, "contained")), None
        found = _search(docs, Sketches(part, width, threshold))
    return _joined(out, found)


def _joined(out: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if out is None else out.unionByName(more)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes | None]]]:
    """The items in blocks of bounded size, at least one; the driver holds one block at a time."""
    block, held, any_yet = [], 0, False
    for row in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        raw = None if row.t is None else row.t.encode()
        size = len(raw or b"") // 4 + 1
        if block and held + size > PASS_SHINGLES:
            yield block
            block, held, any_yet = [], 0, True
        block.append((row.i, raw))
        held += size
    if block or not any_yet:
        yield block


def _search(docs: DataFrame, sketches: Sketches) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketches)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = WordHashes(), shared.value
        for batch in batches:
            rows = [(d, i, q, s, s / q) for d, raw in zip(batch.column(0).to_pylist(), each_text(batch.column(1))) for i, q, s in known.search(raw, memo)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_shared long, containment double")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text contains no test item, whatever their id; a row's own text decides, without a shuffle.

    More items than one block holds take a pass each, over what the passes before have left.
    """
    bounded_batches(docs.sparkSession)
    for k, part in enumerate(_item_blocks(items)):
        docs = _without(materialize(docs, "clean") if k else docs, Sketches(part, width, threshold))
    return docs


def _without(docs: DataFrame, sketches: Sketches) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketches)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = WordHashes(), shared.value
        for batch in batches:
            yield batch.filter(pa.array([not known.search(x, memo) for x in each_text(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
