"""Canonical JSON (RFC 8785), typed floats and digests: a plain core and its Spark columns."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest integer a double holds exactly, and the deepest JSON that is read.
SAFE_INTEGER, MAX_DEPTH = 2**53, 64


class CanonicalError(ValueError):
    """A value that canonical JSON cannot hold."""


def number_text(value: float) -> str:
    """A finite number as ECMAScript writes it: positional from 1e-6 up to below 1e21, else with an exponent."""
    if not math.isfinite(value):
        raise CanonicalError("non-finite number")
    if value == 0:
        return "0"
    text = repr(float(value)).removesuffix(".0")
    mantissa, _, power = text.partition("e")
    if not power:
        return text
    if -7 < int(power) < 21:
        return format(Decimal(text), "f")
    return f"{mantissa}e{int(power):+d}"


_quoted = json.JSONEncoder(ensure_ascii=False).encode if (_c := getattr(json.encoder, "c_encode_basestring", None)) is None else _c


def string_text(value: str) -> str:
    if not value.isascii():
        try:
            value.encode()
        except UnicodeEncodeError:
            raise CanonicalError("lone surrogate") from None
    return _quoted(value)


def _utf16(key: str) -> bytes:
    if not isinstance(key, str):
        raise CanonicalError("object keys are strings")
    return key.encode("utf-16-be", "surrogatepass")


def in_order(cells: dict) -> list[str]:
    """Keys in order of their UTF-16 code units."""
    try:
        return sorted(cells) if "".join(cells).isascii() else sorted(cells, key=_utf16)
    except TypeError:
        raise CanonicalError("object keys are strings") from None


def canonical_json(value) -> str:
    """RFC 8785 text of a JSON value; keys in order of their UTF-16 code units."""
    if type(value) is str:
        return string_text(value)
    match value:
        case None:
            return "null"
        case bool():
            return "true" if value else "false"
        case int():
            if abs(value) > SAFE_INTEGER:
                raise CanonicalError("integer beyond 2^53")
            return int.__repr__(value)
        case float():
            return number_text(value)
        case str():
            return string_text(value)
        case list() | tuple():
            return f"[{','.join([canonical_json(v) for v in value])}]"
        case dict():
            return "{" + ",".join([f"{string_text(k)}:{canonical_json(value[k])}" for k in in_order(value)]) + "}"
    raise CanonicalError(f"no JSON form: {type(value).__name__}")


def digest_of(data: bytes) -> str:
    return f"sha256:{sha256(data).hexdigest()}"


def json_digest(value) -> str:
    return digest_of(canonical_json(value).encode())


#: How non-finite floats stand in JSON.
FLOAT_NAMES = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}


def typed(value):
    """Plain JSON of a value: arrays as lists, bytes as text, non-finite floats as ``{"$float": name}``."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {str(k): typed(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [typed(v) for v in value]
    if isinstance(value, bytes):
        return value.decode()
    if isinstance(value, float) and not math.isfinite(value):
        return {"$float": FLOAT_NAMES[str(value)]}
    return value


def value_digest(value) -> str:
    return json_digest(typed(value))


#: What is no bracket: strings with their quotes, also one that does not end, and all other text.
_NO_BRACKET = re.compile(r'(?:[^"\[\]{}]++|"(?:[^"\\]++|\\.)*+(?:"|\\?\Z))++', re.DOTALL)


def depth_of(text: str) -> int:
    """Deepest nesting of brackets outside strings, without parsing."""
    deep = most = 0
    for ch in _NO_BRACKET.sub("", text):
        if ch in "[{":
            deep += 1
            most = max(most, deep)
        else:
            deep -= 1
    return most


def load_json(text: str | bytes, depth: int = MAX_DEPTH):
    """Parse JSON text of bounded depth; a deeper text is refused before it is parsed."""
    text = text.decode() if isinstance(text, bytes) else text
    if depth_of(text) > depth:
        raise CanonicalError(f"JSON nested deeper than {depth}")
    return json.loads(text)


def _mapped(function, result: str = "string"):
    """A pandas UDF that maps texts one by one; null stays null and what has no canonical form becomes null."""

    def safe(value):
        if value is None:
            return None
        try:
            return function(value)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(result)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.astype(object).where(part.notna(), None).map(safe, na_action=None)

    return run


def canonical_text(text: Column) -> Column:
    """Canonical form of JSON text; null for text that has none."""
    return _mapped(lambda t: canonical_json(load_json(t)))(text)


def canonical_digest(text: Column) -> Column:
    """``sha256:<hex>`` of the canonical form of JSON text."""
    return _mapped(lambda t: json_digest(load_json(t)))(text)


def typed_digest(text: Column) -> Column:
    """Digest of JSON text that may hold bare NaN and Infinity, which take their typed form."""
    return _mapped(lambda t: value_digest(load_json(t)))(text)


def json_depth(text: Column) -> Column:
    return _mapped(depth_of, "int")(text)


def number_column(value: Column) -> Column:
    """Canonical text of a double; null for null, NaN and infinities."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([number_text(v) if math.isfinite(v) else None for v in part], dtype=object)

    return run(value.cast("double"))


def binary_digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


#: The short escapes of JSON.
_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(text: Column) -> Column:
    """The JSON literal of a string column, in the JVM: control characters escaped in lower-case hex."""
    out = text
    for plain, escape in _SHORT.items():
        out = F.replace(out, F.lit(plain), F.lit(escape))
    for code in range(32):
        if chr(code) not in _SHORT:
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text), F.lit('"'))


def flat_json(fields: dict[str, Column]) -> Column:
    """Canonical JSON of a flat record, in the JVM. Values are columns that already hold canonical text."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields, key=_utf16)):
        parts += [F.lit(("," if i else "{") + string_text(key) + ":"), F.coalesce(fields[key], F.lit("null"))]
    return F.concat(*parts, F.lit("}")) if fields else F.lit("{}")


def flat_digest(fields: dict[str, Column]) -> Column:
    return binary_digest(F.encode(flat_json(fields), "UTF-8"))
