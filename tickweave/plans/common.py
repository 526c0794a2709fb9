"""Helpers shared by the query catalog: output normalisation for the oracle comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (6 decimals unless overridden) and turn -0.0 into 0.0, so that
    results of engines that sum in different orders hash alike.  Only the catalog does this;
    library functions return full precision."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            # "+ 0.0" turns -0.0 into 0.0 (IEEE: -0.0 + 0.0 = 0.0)
            out.append((round_half_away(F.col(f.name), overrides.get(f.name, digits)) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def round_half_away(c, digits: int):
    """``round(x * 10^d) / 10^d`` in double arithmetic, halves away from zero — the rounding
    the SQL oracle applies.  ``F.round`` instead rounds the shortest decimal text of the
    double through a BigDecimal per value: slower, and it can land one unit apart on values
    whose text ends in 5 just past the last kept digit."""
    m = float(10 ** digits)
    a = F.abs(c * F.lit(m))
    r = F.when(a < F.lit(2.0 ** 52), F.floor(a + F.lit(0.5)).cast("double")).otherwise(a)
    return F.signum(c) * r / F.lit(m)


def sql_round(expr: str, alias: str, digits: int = 6) -> str:
    """The SQL twin of :func:`round_doubles` for one expression."""
    r = f"round(CAST(({expr}) AS DOUBLE), {digits})"
    return f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END AS {alias}"
