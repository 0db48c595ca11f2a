"""Publishing doubles so that two engines print the same digits.

``snap(x, q) = floor(x·q + SNAP_OFFSET) / q``: a fixed-grid quantiser whose cell boundaries sit
at the golden-ratio fraction of a step, so values that are ratios of small integers (common when
inputs are multiples of 1/1000 divided by document lengths) never fall on a boundary. The SQL
twins use the same constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed value ------------------------------------------------------------------------------------
SNAP_OFFSET = 0.6180339887498949
# ----------------------------------------------------------------------------------------------------


def snap(c: Column, q: float = 1e6) -> Column:
    return F.floor(c * F.lit(q) + F.lit(SNAP_OFFSET)) / F.lit(q)
