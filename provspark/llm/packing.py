"""Bounded-space online packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import bounded_batches, materialize
from provspark.llm.tokens import Encoder

CAPACITY, OPEN, END_ID = 2048, 64, 1
#: Partitions whose leftover windows are merged together.
MERGED = 16
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [x.split()[0] for x in _SCHEMA.split(", ")]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Windows:
    """At most ``most`` open windows; a piece goes where it leaves least room, else the fullest window is emitted."""

    def __init__(self, capacity: int, most: int | None):
        self.capacity, self.most, self.serial = capacity, most, 0
        self.free: list[tuple[int, int]] = []  # (room, serial), ascending
        self.held: dict[int, list] = {}

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece in a window; returns the pieces of a window that is closed by this, if any."""
        at, closed = bisect_left(self.free, (size, -1)), None
        if at < len(self.free):
            room, key = self.free.pop(at)
        else:
            if self.most and len(self.free) >= self.most:
                closed = self.held.pop(self.free.pop(0)[1])
            room, key = self.capacity, self.serial
            self.serial += 1
            self.held[key] = []
        self.held[key].append(piece)
        if room > size:
            insort(self.free, (room - size, key))
            return closed
        full = self.held.pop(key)
        return full  # a piece either filled a window that was open or took a new, larger one: never both

    def rest(self) -> list[list]:
        return [self.held[k] for _, k in self.free]


def _columns(rows: list[tuple], extra: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * len(_FIELDS) + [pa.binary() if x == "ids" else pa.int64() for x in extra]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [*_FIELDS, *extra])


def _sequence(pieces: list[tuple], ident: int | None) -> Iterator[tuple]:
    offset = 0
    for p in pieces:
        yield (*p[:5], ident, offset, *p[5:])
        offset += p[2]


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, open_windows: int = OPEN, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Every whole text (null: empty) is encoded and ``end_id`` appended. A document is cut only into windows it
    fills and one rest below ``capacity``. Each partition packs its rests online with ``open_windows`` open
    windows; what stays open at its end is merged with that of the next partitions, largest pieces first.
    Repeated rows and equal or null doc_ids are packed as documents of their own. No rows: no pieces.
    """
    path = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)
    extra = ["ids"] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        part = TaskContext.get().partitionId()
        windows, serial, rows = Windows(capacity, open_windows), 0, []

        def emit(pieces):
            nonlocal serial
            rows.extend((*x, part) for x in _sequence(pieces, part << 32 | serial))
            serial += 1

        for batch in batches:
            at = 0
            for ids, ends in encoder.blocks(batch.column(1), end_id):
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for doc, begin, end in zip(batch.column(0).slice(at, len(ends)).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    for start in range(0, end - begin, capacity):
                        size = min(capacity, end - begin - start)
                        own = raw[4 * (begin + start) : 4 * (begin + start + size)]
                        piece = (doc, start, size, zlib.crc32(own), end - begin, *([bytes(own)] if with_ids else []))
                        if size == capacity:
                            emit([piece])
                        elif closed := windows.place(piece, size):
                            emit(closed)
                    if len(rows) > 5000:
                        yield _columns(rows, [*extra, "_part"])
                        rows = []
                at += len(ends)
        for pieces in windows.rest():
            rows.extend((*x, part) for x in _sequence(pieces, None))
        yield _columns(rows, [*extra, "_part"])

    schema = _SCHEMA + ", ids binary" * with_ids
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = materialize(plain.mapInArrow(run, schema + ", _part long"), "packed")

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        cols = [table[c].to_pylist() for c in [*_FIELDS[:5], *extra]]
        pieces = sorted(zip(*cols), key=lambda p: (-p[2], p[0] is not None, p[0] or 0, p[1], p[3]))
        windows, done = Windows(capacity, None), []
        for p in pieces:
            if closed := windows.place(p, p[2]):
                done.append(closed)
        rows = [x for i, s in enumerate([*done, *windows.rest()]) for x in _sequence(s, 1 << 62 | group << 32 | i)]
        return pa.Table.from_batches([_columns(rows, extra)])

    left = placed.where("sequence_id is null").withColumn("_group", F.floor(F.col("_part") / MERGED).cast("long")).drop("_part")
    merged = left.groupBy("_group").applyInArrow(merge, schema)
    return placed.where("sequence_id is not null").drop("_part").unionByName(merged)
