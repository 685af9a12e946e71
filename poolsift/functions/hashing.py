"""Seeded, partition-independent randomness.

Every random choice in the library is keyed by ``md5('<seed>:<uid>')`` so
the answer depends only on the seed and the row id: never on partitioning,
row order or the machine.  The same expressions exist in plain SQL, which
is what lets the DuckDB oracle reproduce every sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_key(seed, uid="uid") -> Column:
    """Hex md5 of ``'<seed>:<uid>'``; sort by it, then by uid, to sample."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(uid).cast("string")))


def bucket_of(seed, uid="uid", hex_digits: int = 4) -> Column:
    """Leading hex digits of the order key as an integer bucket (monotone in the key)."""
    return F.conv(F.substring(order_key(seed, uid), 1, hex_digits), 16, 10).cast("bigint")


def uniform(seed, uid="uid") -> Column:
    """u in (0, 1) from the first 32 bits of the order key."""
    return (bucket_of(seed, uid, 8) + F.lit(0.5)) / F.lit(TWO_POW_32)


def gumbel(seed, uid="uid") -> Column:
    """Standard Gumbel noise ``-ln(-ln u)``."""
    return -F.ln(-F.ln(uniform(seed, uid)))


# SQL spellings used by the DuckDB oracle (kept next to the Spark ones).
def sql_order_key(seed, uid: str = "uid") -> str:
    return f"md5('{seed}:' || CAST({uid} AS VARCHAR))"


def sql_uniform(seed, uid: str = "uid") -> str:
    return f"((('0x' || substr({sql_order_key(seed, uid)}, 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def sql_gumbel(seed, uid: str = "uid") -> str:
    return f"(-ln(-ln({sql_uniform(seed, uid)})))"
