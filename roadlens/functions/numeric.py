"""Output rounding that both engines compute bit-identically."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x, d: int = 6) -> Column:
    """floor(x * 10^d + 0.5) / 10^d - same IEEE steps in Spark and DuckDB, unlike
    ``round`` (Spark rounds the decimal text HALF_UP, DuckDB the scaled double)."""
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10**d)
    return F.floor(c * scale + 0.5) / scale
