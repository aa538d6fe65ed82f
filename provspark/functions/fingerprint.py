"""Fingerprints of signals and images, and the facts recorded of a state."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from provspark.functions.canon import canonical_json, json_digest, load_json, typed

# Scheme identifiers of stored fingerprints.
SIGNAL_V1 = "datalab-signal-v1"
SIGNAL_V2 = "datalab-signal-v2"
IMAGE_V1 = "datalab-image-v1"

#: Bytes hashed at once where an array must be copied to be hashed.
COPY = 8 << 20


def _little(dtype: np.dtype) -> np.dtype:
    return dtype.newbyteorder("<")


def _digest(descriptor: dict, arrays: list[np.ndarray]) -> str:
    """SHA-256 of the canonical descriptor, a NUL byte and the arrays in C order, little-endian."""
    hasher = sha256(canonical_json(descriptor).encode() + b"\0")
    for array in arrays:
        want = _little(array.dtype)
        if array.dtype == want and array.flags.c_contiguous:
            hasher.update(memoryview(array).cast("B") if array.size else b"")
            continue
        flat, step = array.reshape(-1) if array.flags.c_contiguous else array.flat, max(1, COPY // want.itemsize)
        for at in range(0, array.size, step):
            hasher.update(np.asarray(flat[at : at + step], want).tobytes())
    return f"sha256:{hasher.hexdigest()}"


def scientific_rows(x, y, dx=None, dy=None) -> dict[str, np.ndarray]:
    """The rows a signal's fingerprint covers: x and dx as real float64, y and dy in their own type.

    An uncertainty row that is absent or holds only NaN is left out.
    """
    rows = {"x": np.asarray(x).real.astype("f8", copy=False), "y": np.asarray(y)}
    for name, row in (("dx", dx), ("dy", dy)):
        row = None if row is None else np.asarray(row)
        if row is None or (row.dtype.kind in "fc" and np.isnan(row).all()):
            continue
        rows[name] = row.real.astype("f8", copy=False) if name == "dx" else row
    sizes = {r.shape for r in rows.values()}
    if len(sizes) != 1 or len(next(iter(sizes))) != 1:
        raise ValueError("rows of a signal are 1-D and of one length")
    if any(r.dtype.kind not in "biufc" for r in rows.values()):
        raise ValueError("rows of a signal are numeric")
    return rows


def signal_fingerprint(x, y, dx=None, dy=None, xunit: str | None = "", yunit: str | None = "", scheme: str | None = None) -> dict[str, str]:
    """``{"scheme", "value"}``; without ``scheme``, v1 if the rows share one dtype, else v2."""
    rows = scientific_rows(x, y, dx, dy)
    types = {k: _little(r.dtype).str for k, r in rows.items()}
    one = len(set(types.values())) == 1
    scheme = scheme or (SIGNAL_V1 if one else SIGNAL_V2)
    record = {"scheme": scheme, "length": len(rows["x"]), "units": {"x": xunit or "", "y": yunit or ""}}
    if scheme == SIGNAL_V2:
        record["rows"] = [{"name": k, "dtype": t} for k, t in types.items()]
    elif one:
        record |= {"dtype": types["x"], "rows": list(rows)}
    else:
        raise ValueError("this scheme takes rows of one dtype")
    return {"scheme": scheme, "value": _digest(record, list(rows.values()))}


def image_fingerprint(data, x0=0.0, y0=0.0, dx=1.0, dy=1.0, xcoords=None, ycoords=None, xunit="", yunit="", zunit="") -> dict[str, str]:
    """``{"scheme", "value"}`` of a 2-D array; uniform coordinates unless both coordinate rows are given."""
    data = np.asarray(data)
    if data.ndim != 2:
        raise ValueError("an image is 2-D")
    arrays = [data]
    if xcoords is None or ycoords is None:
        coords = {"uniform": {"x0": float(x0), "y0": float(y0), "dx": float(dx), "dy": float(dy)}}
    else:
        across, down = np.asarray(xcoords, "<f8"), np.asarray(ycoords, "<f8")
        if (down.shape, across.shape) != ((data.shape[0],), (data.shape[1],)):
            raise ValueError("coordinates and image differ in size")
        coords = {"nonuniform": {"x": across.size, "y": down.size}}
        arrays += [across, down]
    record = {"scheme": IMAGE_V1, "dtype": _little(data.dtype).str, "shape": list(data.shape), "coords": coords, "units": {"x": xunit or "", "y": yunit or "", "z": zunit or ""}}
    return {"scheme": IMAGE_V1, "value": _digest(record, arrays)}


def roi_facts(definition) -> dict | None:
    if definition is None:
        return None
    plain = typed(definition)
    return {"definition": plain, "digest": json_digest(plain)}


#: What ``state_facts`` returns of an object.
FACTS = "object_uuid string, kind string, fp_scheme string, fp_value string, dtype string, length long, shape array<long>, rows array<string>, roi_digest string, problem string"
#: Rows handled at once; a row may hold a large array.
BATCH = 64


def _array(payload, dtype: str | None) -> np.ndarray | None:
    if payload is None:
        return None
    if isinstance(payload, bytes | bytearray | memoryview):
        return np.frombuffer(payload, np.dtype(dtype or "<f8"))
    return np.asarray(payload, np.dtype(dtype or "<f8"))


def object_facts(row: dict) -> tuple:
    """Facts of one object: kind, rows or data (numbers, or bytes with their dtype), units and ROI as JSON text."""
    try:
        roi = roi_facts(load_json(row["roi_json"])) if row.get("roi_json") is not None else None
        digest = roi and roi["digest"]
        unit = lambda k: row.get(k) or ""
        if row["kind"] == "image":
            data = _array(row["data"], row.get("dtype")).reshape([int(n) for n in row["shape"]])
            extra = {k: _array(row.get(k), None) for k in ("xcoords", "ycoords")}
            coords = {k: row[k] for k in ("x0", "y0", "dx", "dy") if row.get(k) is not None}
            fp = image_fingerprint(data, **coords, **extra, xunit=unit("xunit"), yunit=unit("yunit"), zunit=unit("zunit"))
            return row["object_uuid"], "image", fp["scheme"], fp["value"], data.dtype.name, None, list(data.shape), ["data"], digest, None
        parts = [_array(row.get(k), row.get("dtype") if k in ("y", "dy") else None) for k in ("x", "y", "dx", "dy")]
        rows = scientific_rows(*parts)
        fp = signal_fingerprint(*parts, unit("xunit"), unit("yunit"))
        return row["object_uuid"], "signal", fp["scheme"], fp["value"], rows["y"].dtype.name, len(rows["y"]), None, list(rows), digest, None
    except (ValueError, TypeError, AttributeError, KeyError) as error:
        return row.get("object_uuid"), row.get("kind"), None, None, None, None, None, None, None, str(error)


def state_facts(objects: DataFrame) -> DataFrame:
    """Facts of every row of ``objects``, column-pruned to what a fingerprint covers. One pass, no shuffle.

    Columns read where present: object_uuid, kind, x, y, dx, dy, data, shape, dtype, xcoords, ycoords, x0, y0, units
    and roi_json. Objects that cannot be fingerprinted have a ``problem`` and no fingerprint.
    """
    known = ["object_uuid", "kind", "x", "y", "dx", "dy", "data", "shape", "dtype", "xcoords", "ycoords", "x0", "y0", "xunit", "yunit", "zunit", "roi_json"]
    names = [c for c in known if c in objects.columns]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            for at in range(0, len(part), BATCH):
                found = [object_facts(r) for r in part.iloc[at : at + BATCH].to_dict("records")]
                yield pd.DataFrame(found, columns=[f.split()[0] for f in FACTS.split(", ")])

    return objects.select(*names).mapInPandas(run, FACTS)
