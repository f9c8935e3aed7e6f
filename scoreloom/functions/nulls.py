"""Null, sentinel and zero rules as Column expressions.

After the source boundary the only missing value is ``null``: NaN and both
infinities are turned into null once (``finite``), so no later aggregate can
meet a NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def missing_if(col: Column, *sentinels) -> Column:
    """Null where ``col`` equals one of the sentinel values."""
    return F.when(~col.isin(*sentinels), col)


def keep_from(col: Column, bound) -> Column:
    """Null where ``col`` lies below ``bound``."""
    return F.when(col >= F.lit(bound), col)


def finite(col: Column) -> Column:
    """Null for NaN and for both infinities."""
    return F.when(~(F.isnan(col) | col.isin(float("inf"), float("-inf"))), col)


def finite_frame(df: DataFrame) -> DataFrame:
    """``finite`` over every float and double column, one projection."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(
        *[finite(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]
    )


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def flag_not_equal(col: Column, value) -> Column:
    """1 where ``col`` differs from ``value``; a missing value differs too."""
    return (~col.eqNullSafe(F.lit(value))).cast("int")


def positive_part(col: Column) -> Column:
    """max(col, 0); missing counts as 0 (``greatest`` skips null)."""
    return F.greatest(col, F.lit(0).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null when the divisor is 0 or either side is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_div_sql(a: str, b: str) -> str:
    """a / b as SQL text, but a zero divisor gives 0.0, also for a missing a; otherwise missing stays missing."""
    return f"CASE WHEN {b} = 0 THEN 0D ELSE try_divide(cast({a} AS DOUBLE), cast({b} AS DOUBLE)) END"


def safe_div(a: str, b: str) -> Column:
    return F.expr(safe_div_sql(a, b))


def fill_constant(df: DataFrame, value, columns: list[str]) -> DataFrame:
    """Optional null fill of the named columns."""
    return df if value is None else df.fillna({c: value for c in columns})
