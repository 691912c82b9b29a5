"""SHA-256 identities over canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_PREFIX = "sha256:"
ZERO_HASH = "00" * 32


def sha_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def sha_bin(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def content_json(*cols: Column) -> Column:
    """One compact JSON object with every field written, NULLs included."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def content_id(*cols: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), sha_hex(content_json(*cols)))


def canonical_json(text: Column) -> Column:
    """Sorted keys, compact, explicit nulls kept; malformed or duplicate-key text gives NULL."""
    return F.to_json(F.try_parse_json(text))


def evidence_id(canonical: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), sha_hex(canonical))
