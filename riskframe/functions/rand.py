"""Repeatable randomness from md5.

Spark's ``rand()`` is not repeatable across engines or across a
re-run after a lost executor with a different partitioning, so every
draw in this library is a pure function of ``(salt, key)``:
``b(salt, key)`` = the first 8 hex digits of ``md5(salt || ':' || key)``
read as a BIGINT in ``[0, 2**32)``. DuckDB computes the same number with
``('0x' || substr(md5(salt || ':' || key), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = float(2 ** 32)


def _key(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return k.cast("string")


def b(salt, key) -> Column:
    """BIGINT draw in [0, 2**32). ``salt`` may be a str or a Column."""
    s = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    h = F.md5(F.concat(s, F.lit(":"), _key(key)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def b60(salt, key) -> Column:
    """BIGINT draw in [0, 2**60): for row indexes, which a 32-bit draw could not all reach."""
    s = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    h = F.md5(F.concat(s, F.lit(":"), _key(key)))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def u(salt, key) -> Column:
    """Uniform double in [0, 1)."""
    return b(salt, key) / F.lit(TWO32)


def duck_b(salt: str, key_sql: str) -> str:
    """The same draw as DuckDB SQL text (for oracle queries)."""
    return (f"('0x' || substr(md5('{salt}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT")


def duck_b60(salt: str, key_sql: str) -> str:
    return (f"('0x' || substr(md5('{salt}:' || CAST({key_sql} AS VARCHAR)), 1, 15))::BIGINT")


def duck_u(salt: str, key_sql: str) -> str:
    return f"({duck_b(salt, key_sql)} / 4294967296.0)"
