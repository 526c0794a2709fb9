"""Display formatting and text fills (P5, P6, P7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickweave import constants as K


def money(c: Column, decimals: int = 2) -> Column:
    """Thousands separators and fixed decimals: ``1,234,567.89``.  [P7]"""
    return F.format_number(c, decimals)


def fixed(c: Column, decimals: int = 2) -> Column:
    """Fixed decimals without thousands separators (``f"{x:.2f}"``).  ``format_number`` rounds
    the exact binary value half-even, as Python's formatting does; only its separators are
    removed.  [P7]"""
    return F.regexp_replace(F.format_number(c, decimals), ",", "")


def int_text(c: Column) -> Column:
    """Integer with thousands separators, truncating like ``int()`` (average volume).  [P7]"""
    return F.format_number(c.cast("long"), 0)


def fill_text(c: Column, decimals: int = 2) -> Column:
    """A value as text, ``N/A`` when missing.  Numbers go through a decimal so that large
    values are not printed in scientific notation.  [P5]"""
    return F.coalesce(c.cast(f"decimal(38,{decimals})").cast("string"), F.lit(K.MISSING_TEXT))


def map_field(m: Column, key: str, default: str = K.MISSING_TEXT) -> Column:
    """``info.get(key, 'N/A')`` on a string map.  [P6]"""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))
