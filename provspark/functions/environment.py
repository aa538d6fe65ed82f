"""The record of a running environment; it names no host and no user."""

from __future__ import annotations

import mimetypes
import platform
import sys
from collections.abc import Iterable
from importlib import metadata

from pyspark.sql import Column
from pyspark.sql import functions as F

from provspark.functions import canon
from provspark.functions.canon import json_digest

#: Editions, and the most attachments an origin lists.
EDITIONS, MAX_ORIGIN = ("desktop", "web"), 1000


def _version(package: str) -> str | None:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def collect(edition: str, version: str, revision: str | None = None, packages: Iterable[str] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict:
    """The interpreter's environment record; packages that are not there have version None."""
    if edition not in EDITIONS:
        raise ValueError(f"no such edition: {edition}")
    interpreter = {"implementation": platform.python_implementation(), "version": platform.python_version()}
    return {"edition": edition, "edition_version": str(version), "edition_revision": revision, "python": interpreter, "platform": sys.platform, "machine": platform.machine(), "pyodide": None, "packages": {p: _version(p) for p in packages}}


def environment_id(record: dict) -> str:
    return json_digest(record)


def check_origin(origin: dict) -> dict:
    """A checked copy of ``{"fingerprint", "name", "attachments"}``; ValueError if it has another form."""
    keys = {"fingerprint", "name", "attachments"}
    if not isinstance(origin, dict) or set(origin) != keys:
        raise ValueError("an origin has fingerprint, name and attachments")
    fingerprint, name, files = (origin[k] for k in ("fingerprint", "name", "attachments"))
    digits = fingerprint.removeprefix("sha256:") if isinstance(fingerprint, str) else ""
    if len(digits) != 64 or fingerprint == digits or set(digits) - set("0123456789abcdef"):
        raise ValueError("an origin's fingerprint is a digest")
    if not (name is None or isinstance(name, str)):
        raise ValueError("an origin's name is a text")
    if not isinstance(files, list | tuple) or len(files) > MAX_ORIGIN or not all(isinstance(f, str) for f in files):
        raise ValueError("an origin's attachments are names")
    return {"fingerprint": fingerprint, "name": name, "attachments": list(files)}


def origin_sound(text: Column) -> Column:
    """Whether JSON text is a whole capsule origin, as ``check_origin`` has it; text that is no JSON is not."""

    def sound(found: str) -> bool:
        return check_origin(canon.load_json(found)) is not None

    return F.coalesce(canon._mapped(sound, "boolean")(text), F.lit(False))


def media_type(name: str) -> str:
    return mimetypes.guess_type(name)[0] or "application/octet-stream"
