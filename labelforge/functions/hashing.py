"""Deterministic hashing used for seeded order keys and fixtures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def h32(id_col: Column, salt) -> Column:
    """First 32 bits of ``md5(id || ':' || salt)`` as a non-negative bigint.

    Same value as ``('0x'||substr(md5(id||':'||salt),1,8))::BIGINT`` in DuckDB."""
    digest = F.md5(F.concat(id_col.cast("string"), F.lit(":"), _c(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def order_key(id_col: Column, seed: int = 42) -> Column:
    """Seeded, uniform order key (hex md5). Never ``rand()``: it must be
    identical on re-execution after an executor loss."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))
