"""Reproducible random draws: a row's draw depends only on its key and a salt.

``rand()`` would be evaluated again on a task retry or when a plan is duplicated, so the draws hash
the key instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits: every value is exact in a double
_SPAN = float(16**_HEX_DIGITS)


def key_digest(key: Column, salt: str) -> Column:
    """32 hex digits, uniform over keys; the order used for sampling and row numbering."""
    return F.md5(F.concat(key.cast("string"), F.lit("|" + salt)))


def unit_draw(key: Column, salt: str) -> Column:
    """Uniform in [0, 1)."""
    digits = F.substring(key_digest(key, salt), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_SPAN)


def uniform_draw(key: Column, salt: str, low: Column | float, high: Column | float) -> Column:
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return low + (high - low) * unit_draw(key, salt)
