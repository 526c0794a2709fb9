"""Company statements and profiles: R1, P2, P5, P6."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave import constants as K
from tickweave.functions.formatting import fill_text, map_field


def statement_wide(long: DataFrame, items: list[str], keys=("symbol", "period"),
                   other: str | None = None) -> DataFrame:
    """Long ``(symbol, period, item, value)`` -> one row per period, one column per item;
    an absent cell is NULL.  [R1]  The item list is explicit, so ``pivot`` needs no extra job
    to find the distinct values; with ``other``, items outside the list are kept in a map column
    of that name (item -> value) instead of being left out."""
    wide = long.groupBy(*keys).pivot("item", items).agg(F.sum("value"))
    if other is None:
        return wide
    rest = (long.filter(F.col("item").isNotNull() & ~F.col("item").isin(items))
            .groupBy(*keys, "item").agg(F.sum("value").alias("value")).groupBy(*keys)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", "value")))).alias(other)))
    rest = rest.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & wide[k].eqNullSafe(rest[f"_r_{k}"])
    return wide.join(rest, on, "left").drop(*[f"_r_{k}" for k in keys])


def statement_views(long: DataFrame, items: dict[str, list[str]], kind_col: str = "statement",
                    keys=("symbol", "period")) -> dict[str, DataFrame]:
    """One wide frame per statement kind (income statement, balance sheet, cash flow), each with its own
    items only.  [R1]  ``items`` names the kinds and their line items in display order; lines of other
    kinds, or without one, are in no view. Each view filters on the kind before it pivots, so a table
    partitioned by kind is read in part."""
    return {kind: statement_wide(long.filter(F.col(kind_col) == kind), wanted, keys) for kind, wanted in items.items()}


def select_available(df: DataFrame, wanted: list[str], keys=("symbol", "period")) -> DataFrame | None:
    """Keep the wanted columns that exist, in the frame's own order; ``None`` when there are
    none ("not available").  [P2]  Schema-level, no job."""
    have = [c for c in df.columns if c in wanted]
    if not have:
        return None
    return df.select(*keys, *[F.col(f"`{c}`") for c in have])


def fill_and_stringify(df: DataFrame, keys=("symbol", "period")) -> DataFrame:
    """Every non-key column as text, ``N/A`` when missing; columns that are not numbers keep their
    own text.  [P5]"""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    kinds = dict(df.dtypes)

    def text(c: str):
        col = F.col(f"`{c}`")
        return fill_text(col) if kinds[c].startswith(numbers) else F.coalesce(col.cast("string"), F.lit("N/A"))

    return df.select(*keys, *[text(c).alias(c) for c in df.columns if c not in keys])


def profile_fields(profiles: DataFrame, fields=K.PROFILE_FIELDS, map_col: str = "info") -> DataFrame:
    """The shown company-profile fields with their ``N/A`` default.  [P6]"""
    keep = [c for c in profiles.columns if c != map_col]
    return profiles.select(*keep, *[map_field(F.col(map_col), f).alias(f) for f in fields])
