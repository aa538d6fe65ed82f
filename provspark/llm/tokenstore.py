"""Content-addressed store of token ids: rolling-hash chunks kept once, recipes, Merkle manifests.

Layout under a folder, all Parquet: ``chunks/`` (hash, n, payload: ids as little-endian unsigned 16-bit, or 32-bit
where the tokenizer needs it), ``recipes/`` in ascending doc_id order (doc_id, start, n_tokens, chunk hashes, root),
``manifest/`` (one row a recipe file: its documents, tokens and Merkle root).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import drop_path, running_start, scratch_path
from provspark.llm.tokens import Encoder, _load

WINDOW, AVERAGE, LEAST, MOST = 8, 512, 128, 2048


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is; no leaves: the hash of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        paired = [digest(b"\1" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = [*paired, level[-1]] if len(level) % 2 else paired
    return level[0]


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: a rolling hash of the last WINDOW ids has its low bits clear."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    rolled = mixed.copy()
    for k in range(1, min(WINDOW, len(ids))):
        rolled[k:] += mixed[: len(ids) - k] << np.uint64(k)
    return np.flatnonzero((rolled >> np.uint64(WINDOW)) & np.uint64(AVERAGE - 1) == 0) + 1


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of content-defined chunks, each of LEAST to MOST ids, the last one aside. Equal runs are cut alike wherever they stand."""
    return _cuts(len(ids), marks(ids).tolist())


def _cuts(n: int, marks: list[int]) -> list[int]:
    """``cut_points`` of ``n`` ids from their marks. LEAST is over WINDOW, so marks may be found over many documents at once."""
    ends, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n] if last < n else ends


def _narrow(path: str) -> str:
    return "<u2" if _load(path).get_vocab_size() <= 1 << 16 else "<u4"


def _staged(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = Encoder(tokenizer), _narrow(tokenizer)
        for batch in batches:
            at = 0
            for ids, ends in encoder.blocks(batch.column(1), end_id):
                hashes, payloads, roots, firsts = [], [], [], [0]
                found, starts = marks(ids), np.concatenate([[0], ends[:-1]])
                low, high = np.searchsorted(found, starts, "right").tolist(), np.searchsorted(found, ends, "right").tolist()
                wide, narrow = memoryview(ids.astype("<u4", copy=False)).cast("B"), memoryview(ids.astype(kind)).cast("B")
                step = len(narrow) // max(len(ids), 1)
                for start, end, i, j in zip(starts.tolist(), ends.tolist(), low, high):
                    cuts = _cuts(end - start, (found[i:j] - start).tolist())
                    spans = [(start + a, start + b) for a, b in zip([0, *cuts], cuts)]
                    own = [digest(wide[4 * a : 4 * b]) for a, b in spans]
                    hashes += own
                    payloads += [bytes(narrow[step * a : step * b]) for a, b in spans]
                    roots.append(merkle(own))
                    firsts.append(len(hashes))
                offsets = pa.array(firsts, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.binary())) for x in (hashes, payloads)]
                cols = [batch.column(0).slice(at, len(ends)), pa.array(np.diff(ends, prepend=0).astype(np.int64)), *lists, pa.array(roots, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "hashes", "payloads", "root"])
                at += len(ends)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, hashes array<binary>, payloads array<binary>, root binary")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the store.

    Ids are in ascending doc_id order, null ids first, ties by the documents' root. Repeated rows are written
    once a row; their chunks only once. Extra columns are ignored. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    staging = scratch_path(spark, "tokens")
    _staged(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.parquet(staging)
    pairs = staged.select(F.explode(F.arrays_zip("hashes", "payloads")).alias("c"))
    pairs.groupBy(F.col("c.hashes").alias("hash")).agg(F.first("c.payloads").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = running_start(staged.select("doc_id", "n_tokens", "hashes", "root"), "doc_id", ["root"], "n_tokens", "start")
    recipes.repartitionByRange("start").sortWithinPartitions("start").select("doc_id", "start", "n_tokens", "hashes", "root").write.parquet(f"{path}/recipes")
    drop_path(spark, staging)
    _manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _leaf(doc_id: int | None, start: int, n: int, root: bytes) -> bytes:
    return digest(f"{doc_id},{start},{n},".encode() + root)


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row a file of recipes: file name, documents, tokens, and the Merkle root of its documents in order."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["start"].to_pylist(), table["doc_id"].to_pylist(), table["n_tokens"].to_pylist(), table["root"].to_pylist()), key=lambda r: (r[0], r[2], r[3]))
        if any(a[0] + a[2] != b[0] for a, b in zip(rows, rows[1:])):
            raise ValueError(f"documents of {key[0].as_py()} do not join up")
        root = merkle([_leaf(d, s, n, r) for s, d, n, r in rows])
        return pa.table({"file": [key[0].as_py()], "start": [rows[0][0]], "documents": [len(rows)], "n_tokens": [sum(x[2] for x in rows)], "root": [root]})

    named = recipes.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-\d+", 0).alias("file"), "doc_id", "start", "n_tokens", "root")
    return named.groupBy("file").applyInArrow(run, "file string, start long, documents long, n_tokens long, root binary")


def check_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file)``: recipe files and manifest rows that differ in documents, tokens, start or Merkle root, or have no other side; none if the store is whole."""
    stored, found = spark.read.parquet(f"{path}/manifest"), _manifest(spark.read.parquet(f"{path}/recipes"))
    fields = ["file", "start", "documents", "n_tokens", "root"]
    other = stored.select(*fields, F.lit(1).alias("side")).unionByName(found.select(*fields, F.lit(2).alias("side")))
    return other.groupBy(fields).agg(F.sum("side").alias("s")).where("s <> 3").select("file").distinct()


def _check(spark: SparkSession, path: str) -> None:
    """Raise unless the manifest fits the recipe files and each file starts where the one before ends."""
    if wrong := check_manifest(spark, path).head(1):
        raise ValueError(f"{wrong[0].file} and the manifest differ")
    total = 0
    for r in spark.read.parquet(f"{path}/manifest").orderBy("start", "n_tokens").select("file", "start", "n_tokens").toLocalIterator():  # a row a file
        if r.start != total:
            raise ValueError(f"{r.file} does not start where the file before it ends")
        total += r.n_tokens


def _sums(spark: SparkSession, path: str, kind: str, payload: bool) -> DataFrame:
    """Each chunk read and held against its hash: (hash, n, crc of its 32-bit ids[, payload])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc, hashes = [], [], batch.column(0).to_pylist()
            for want, raw in zip(hashes, batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
                if digest(ids) != want:
                    raise ValueError(f"chunk {want.hex()} is damaged")
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
            cols = [batch.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(1)] if payload else cols, ["hash", "n", "crc", "payload"][: 3 + payload])

    chunks = spark.read.parquet(f"{path}/chunks").select("hash", "payload")
    return chunks.mapInArrow(run, "hash binary, n int, crc long" + ", payload binary" * payload)


_ZEROS = bytes(4 * MOST)


def joined_crc(first: int, second: int, size: int) -> int:
    """crc32 of two pieces put together, from their own crc32 and the second one's bytes."""
    return zlib.crc32(_ZEROS[:size], first) ^ zlib.crc32(_ZEROS[:size]) ^ second


def read_store(spark: SparkSession, path: str, tokenizer: str, ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, put together from the files.

    Every chunk is read and checked against its hash once, every document's chunks against its Merkle root, its length
    against the recipe, and every recipe file against the manifest; a difference or a missing chunk raises. Without ``ids`` only each chunk's
    length and crc32 travel to the documents, not its ids: a much-used chunk costs 20 bytes a use.
    """
    kind = _narrow(tokenizer)
    _check(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("hashes").alias("pos", "hash"))
    fields = ["pos", "hash", "n", "crc", *(["payload"] if ids else [])]
    joined = uses.join(_sums(spark, path, kind, ids), "hash", "left").select("doc_id", "start", "n_tokens", "root", F.struct(*fields).alias("c"))
    grouped = joined.groupBy("start", "doc_id", "n_tokens", "root").agg(F.collect_list("c").alias("cs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, texts = [], []
            for n, root, cs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                cs.sort(key=lambda c: c["pos"])
                if any(c["n"] is None for c in cs) or merkle([c["hash"] for c in cs]) != root or sum(c["n"] for c in cs) != n:
                    raise ValueError("a document does not match its recipe")
                crc = 0
                for c in cs:
                    crc = joined_crc(crc, c["crc"], 4 * c["n"])
                crcs.append(crc)
                if ids:
                    texts.append(b"".join(np.frombuffer(c["payload"], kind).astype("<u4").tobytes() for c in cs))
            cols = [batch.column(1), batch.column(0), batch.column(2), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())] if ids else cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])

    return grouped.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
