"""Deterministic seeded hashing that an SQL engine can replay (md5-based)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(row_id: Column, seed: int) -> Column:
    """Unsigned 32-bit value from md5('<row_id>-<seed>'): a reproducible shuffle key."""
    text = F.concat_ws("-", row_id.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
