"""Deterministic pseudo-random draws keyed by md5 of a text key.

Every random choice in the library (permutations, noise, initial weights, sampled topics) is a
pure function of its key, so the result does not depend on partitioning, task retries or the
engine: DuckDB computes the same draws with ``('0x' || substr(md5(s), 1, 12))::BIGINT``.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO48 = float(1 << 48)


def key(*parts) -> Column:
    """``p1:p2:...`` as a string column; literals and columns may be mixed."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(":"))
        cols.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*cols)


def hash48(k: Column) -> Column:
    """First 12 hex digits of md5 as a non-negative BIGINT (48 bits)."""
    return F.conv(F.substring(F.md5(k), 1, 12), 16, 10).cast("bigint")


def uniform(k: Column) -> Column:
    """Uniform draw in [0, 1)."""
    return hash48(k).cast("double") / F.lit(_TWO48)


def normal(k: Column) -> Column:
    """Standard normal draw by Box–Muller over two md5 draws of ``k:u`` and ``k:v``."""
    u = (hash48(F.concat(k, F.lit(":u"))).cast("double") + F.lit(1.0)) / F.lit(_TWO48 + 1.0)
    v = uniform(F.concat(k, F.lit(":v")))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def param_cell(k: Column) -> Column:
    """Fixture parameter value: (h % 2001 - 1000) / 1000 with h = hash48(k)."""
    return (F.pmod(hash48(k), F.lit(2001)) - F.lit(1000)).cast("double") / F.lit(1000.0)


# plain-Python twins (driver-side small tables and unit tests)

def py_hash48(s: str) -> int:
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:12], 16)


def py_param_cell(s: str) -> float:
    return ((py_hash48(s) % 2001) - 1000) / 1000.0
