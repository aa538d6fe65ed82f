"""Capsules: stored ZIP archives of a manifest, a workspace and attachments."""

from __future__ import annotations

import io
import stat
import zipfile
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.operators import archive, manifest
from provspark.operators.archive import ATTACHMENTS, MANIFEST, WORKSPACE, SizePolicy

ENTRIES = "capsule string, ord int, name string, size long, encrypted boolean, symlink boolean, compressed boolean, sha256 string, content binary, problem string"
_ENTRIES = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]) for c in f"{ENTRIES}, repeated boolean".split(", ")])
_CAPSULES = pa.schema([("capsule", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("sha256", pa.string())])


def _limit(policy: SizePolicy, name: str) -> int:
    return {MANIFEST: policy.manifest, WORKSPACE: policy.workspace}.get(name, policy.attachment)


def _entries(capsule: str, data: bytes, policy: SizePolicy, contents: bool) -> Iterator[tuple]:
    """The archive's entries: headers of all, bytes only of those that are plain, stored and within their limit."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as held:
            infos = held.infolist()
            if len(infos) > policy.entries:
                yield (capsule, -1, *[None] * 7, "too many entries")
                return
            for i, info in enumerate(infos):
                encrypted, link, packed = bool(info.flag_bits & 1), stat.S_ISLNK(info.external_attr >> 16), info.compress_type != zipfile.ZIP_STORED
                raw = problem = None
                if not (encrypted or link or packed or info.file_size > _limit(policy, info.filename)):
                    with held.open(info) as stream:  # the declared size is a bound: one byte more is refused
                        raw = stream.read(info.file_size + 1)
                    if len(raw) != info.file_size:
                        raw, problem = None, "size differs from the declared one"
                yield capsule, i, info.filename, info.file_size, encrypted, link, packed, raw and sha256(raw).hexdigest(), raw if contents or info.filename == MANIFEST else None, problem
    except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError, EOFError) as error:
        yield (capsule, -1, *[None] * 7, f"unreadable: {error}")


def _pieces(rows: Iterator[tuple], schema: pa.Schema, content: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` bytes in column ``content``, or of 4,096 rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[content] or b"")
        if size >= most or len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read_entries(spark: SparkSession, path: str, policy: SizePolicy = SizePolicy(), contents: bool = False) -> DataFrame:
    """Entries of every capsule under ``path``, with ``refusal`` by name and header.

    Files over the policy are left out by their size, before a byte is read; each capsule is read in one task.
    Bytes of entries other than the manifest are kept only with ``contents``. An archive that cannot be read has
    one row with a ``problem``.
    """
    most = policy.manifest + policy.workspace + policy.attachments * policy.attachment + (1 << 20)
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= min(most, 2**31 - 1))
    return entries_of(files.select(F.col("path").alias("capsule"), "content"), policy, contents)


def entries_of(files: DataFrame, policy: SizePolicy = SizePolicy(), contents: bool = False) -> DataFrame:
    """``read_entries`` for archives ``files(capsule, content)`` that are in a table."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for name, data in zip(part.column(0), part.column(1)):
                found = list(_entries(name.as_py(), data.as_py(), policy, contents))
                times = Counter(e[2] for e in found)
                yield from ((*e, times[e[2]] > 1) for e in found)

    read = files.select(F.col("capsule").cast("string").alias("capsule"), "content")
    found = read.mapInArrow(lambda parts: _pieces(rows(parts), _ENTRIES, 8), f"{ENTRIES}, repeated boolean")
    judged = archive.entry_refusals(found, "capsule", policy, F.col("repeated"))
    return judged.withColumn("refusal", F.when(F.col("ord") >= 0, F.col("refusal"))).drop("repeated")


def manifests(entries: DataFrame) -> DataFrame:
    """``(manifest, text)``: each capsule's manifest under the capsule's path."""
    return entries.where((F.col("name") == MANIFEST) & F.col("refusal").isNull() & F.col("content").isNotNull()).select(F.col("capsule").alias("manifest"), F.decode("content", "UTF-8").alias("text"))


def attachment(entries: DataFrame, name: str) -> DataFrame:
    """``(capsule, content)`` of one attachment; read the entries with ``contents``."""
    return entries.where((F.col("name") == ATTACHMENTS + name) & F.col("refusal").isNull()).select("capsule", "content")


def archive_bytes(entries: list[tuple[str, bytes]]) -> bytes:
    """A capsule whose bytes follow from its entries alone: stored, dated 1980, readable by all."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as held:
        for name, data in entries:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.create_system, info.external_attr = 3, (stat.S_IFREG | 0o644) << 16
            held.writestr(info, data)
    return out.getvalue()


def create(entries: DataFrame) -> DataFrame:
    """``(capsule, content, size, sha256)`` out of ``entries(capsule, name, content)``: manifest, workspace, then
    attachments by name. A capsule is put together in one task; the size policy bounds it.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rank = {MANIFEST: 0, WORKSPACE: 1}
        for part in parts:
            for name, held in zip(part.column(0), part.column(1)):
                found = [(e["name"], e["content"]) for e in held.as_py()]
                data = archive_bytes(sorted(found, key=lambda r: (rank.get(r[0], 2), r[0])))
                yield name.as_py(), data, len(data), f"sha256:{sha256(data).hexdigest()}"

    gathered = entries.groupBy(F.col("capsule").cast("string").alias("capsule")).agg(F.collect_list(F.struct("name", "content")).alias("held"))
    return gathered.mapInArrow(lambda parts: _pieces(rows(parts), _CAPSULES, 1), "capsule string, content binary, size long, sha256 string")


def opened(entries: DataFrame) -> DataFrame:
    """``(capsule, content, origin)``: each capsule's workspace bytes, and the record of where they came from, as JSON.

    Read the entries with ``contents``. A capsule without a workspace entry (a referenced one) has no row.
    """
    work = entries.where((F.col("name") == WORKSPACE) & F.col("refusal").isNull() & F.col("content").isNotNull()).select("capsule", "content")
    files = entries.where(F.col("name").startswith(ATTACHMENTS) & F.col("refusal").isNull()).groupBy("capsule").agg(F.array_sort(F.collect_list(F.substring("name", len(ATTACHMENTS) + 1, 1 << 20))).alias("attachments"))
    roots = manifest.outline(manifests(entries)).select(F.col("manifest").alias("capsule"), F.inline("roots"))
    listed = F.coalesce("attachments", F.array().cast("array<string>"))
    origin = F.to_json(F.struct("fingerprint", "name", listed.alias("attachments")), {"ignoreNullFields": "false"})
    return work.join(roots, "capsule").join(files, "capsule", "left").select("capsule", "content", origin.alias("origin"))
