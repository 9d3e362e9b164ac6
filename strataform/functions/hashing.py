"""Deterministic hash expressions, equal bit by bit on every engine that has SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits of the SHA-256 of text as a bigint; null for null."""
    return F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, digits), 16, 10).cast("bigint")


def unit_hash(salt: str, key: Column) -> Column:
    """A double in [0, 1) from salt:key (15 hex digits); null for a null key."""
    return hex_number(F.concat(F.lit(f"{salt}:"), key.cast("string")), 15) / F.lit(float(16**15))


def hash_bucket(salt: str, key: Column, buckets: int) -> Column:
    """A bucket from 0 to buckets - 1 from salt:key (8 hex digits); null for a null key."""
    return F.pmod(hex_number(F.concat(F.lit(f"{salt}:"), key.cast("string")), 8), F.lit(buckets))


def split_rule(official: Column, excluded: Column, unit: Column, shares: dict[str, float]) -> Column:
    """official where it is given and not excluded; excluded rows give excluded; the rest go by unit to the shares in order."""
    edge, out = 0.0, None
    for name, share in shares.items():
        edge += share
        out = F.when(unit < edge, name) if out is None else out.when(unit < edge, name)
    return F.when(excluded, "excluded").when(official.isNotNull(), official).otherwise(out.otherwise(list(shares)[-1]))
