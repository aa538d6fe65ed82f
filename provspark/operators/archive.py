"""Checks of archive entries and file names, and the limits of what is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.operators.check import cascade
from provspark.schemas import ATTACHMENT_NAME

# Names of the archive's entries.
MANIFEST, WORKSPACE, ATTACHMENTS = "ro-crate-metadata.json", "workspace.h5", "attachments/"
#: Device names that some systems do not allow as a file's stem.
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
_MIB = 1 << 20


@dataclass(frozen=True)
class SizePolicy:
    """Most entries, and most bytes of each kind of entry."""

    entries: int = 16
    manifest: int = 64 * _MIB
    workspace: int = 4096 * _MIB
    attachments: int = 8
    attachment: int = 16 * _MIB

    def limit(self, name: Column) -> Column:
        return F.when(name == MANIFEST, self.manifest).when(name == WORKSPACE, self.workspace).when(name.startswith(ATTACHMENTS), self.attachment).otherwise(0).cast("long")


def valid_attachment_name(name: Column) -> Column:
    return F.coalesce(name.rlike(ATTACHMENT_NAME), F.lit(False))


def entry_refusals(entries: DataFrame, key: str, policy: SizePolicy = SizePolicy(), twice: Column | None = None) -> DataFrame:
    """``entries(key, name, size, encrypted, symlink, compressed)`` with ``refusal``: the first that holds, or null.

    ``twice`` says whether an entry's name stands twice in its archive, where that is known; else names are counted.
    """
    name = F.col("name")
    parts = F.split(name, "/")
    twice = F.count("*").over(Window.partitionBy(key, "name")) > 1 if twice is None else twice
    attached = name.startswith(ATTACHMENTS)
    refusal = cascade(
        (name.isNull() | (name == ""), "empty"),
        (name.startswith("/"), "absolute"),
        (name.contains("\\"), "backslash"),
        (F.array_contains(parts, ".."), "parent"),
        (name.rlike("^[A-Za-z]:"), "drive"),
        (twice, "duplicate"),
        (attached & ~valid_attachment_name(F.substring(name, len(ATTACHMENTS) + 1, 1 << 20)), "attachment_name"),
        (~attached & ~name.isin(MANIFEST, WORKSPACE), "unexpected"),
        (F.col("encrypted"), "encrypted"),
        (F.col("symlink"), "symlink"),
        (F.col("compressed"), "compressed"),
        (F.col("size") > policy.limit(name), "too_large"),
    )
    return entries.withColumn("refusal", refusal)


def sanitized(name: Column) -> Column:
    """A file name as an attachment name: other characters become ``_``, ``file`` goes before a first character that is
    no letter or digit, and 96 characters are kept."""
    plain = F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")
    return F.substring(F.when(plain.rlike("^[A-Za-z0-9]"), plain).otherwise(F.concat(F.lit("file"), plain)), 1, 96)


def portable(name: Column) -> Column:
    """False for a device name before the first dot, or a name that ends in a dot or blank."""
    stem = F.upper(F.trim(F.split_part(name, F.lit("."), F.lit(1))))
    return ~(stem.isin(*DEVICES) | name.endswith(".") | name.endswith(" "))


def valid_path(path: Column, roots: tuple[str, ...]) -> Column:
    """A locator path: absolute, three parts, under a known root, without ``..``."""
    parts = F.split(path, "/")
    return F.coalesce(path.startswith("/") & (F.size(parts) == 4) & F.get(parts, 1).isin(*roots) & ~F.exists(parts, lambda p: p == "..") & (F.size(F.filter(parts, lambda p: p == "")) == 1), F.lit(False))


def short_id(text: Column) -> Column:
    """An id as it is shown: the first block of a UUID, twelve digits of a digest."""
    return F.when(text.startswith("sha256:"), F.substring(text, 8, 12)).otherwise(F.split_part(text, F.lit("-"), F.lit(1)))


def utc_text(when: Column) -> Column:
    """A timestamp as ``YYYY-MM-DDTHH:MM:SS.mmmZ``; the session's zone is UTC."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
