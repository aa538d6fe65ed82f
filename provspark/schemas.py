"""Patterns of identifiers."""

from __future__ import annotations

#: Patterns of identifiers. The end is strict: no line break may follow.
DIGEST = r"^sha256:[0-9a-f]{64}\z"
HEX64 = r"^[0-9a-f]{64}\z"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
OPERATION = r"^[a-z0-9]+(?:[._-][a-z0-9]+)*\z"
ATTACHMENT_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}\z"
SIZE_TEXT = r"^(?:0|[1-9][0-9]*)\z"
