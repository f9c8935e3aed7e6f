"""Frame-level cleaning: splits, column drops, lossless narrowing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType

from .profile import collect_stats, numeric_columns


def split_by_label(df: DataFrame, label: str = "TARGET") -> tuple[DataFrame, DataFrame]:
    """(labelled rows, unlabelled rows without the label column)."""
    return df.filter(F.col(label).isNotNull()), df.filter(F.col(label).isNull()).drop(label)


def incomplete_columns(df: DataFrame, columns: Sequence[str], label: str = "TARGET") -> list[str]:
    """Columns that miss a value in the labelled or in the unlabelled rows.

    Both halves together are the whole table, so one aggregate answers for both.
    """
    columns = list(columns)
    if not columns:
        return []
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]
    ).first()
    return [c for i, c in enumerate(columns) if row[f"n{i}"] < row["rows"]]


def drop_incomplete(df: DataFrame, keep: Sequence[str] = ("SK_ID_CURR", "TARGET")) -> DataFrame:
    return df.drop(*incomplete_columns(df, [c for c in df.columns if c not in keep]))


# Integer types from narrow to wide with their bounds.
_INTEGERS = [
    (ByteType(), -(2**7), 2**7 - 1),
    (ShortType(), -(2**15), 2**15 - 1),
    (IntegerType(), -(2**31), 2**31 - 1),
    (LongType(), -(2**63), 2**63 - 1),
]
_FLOAT_MAX = 3.4028234663852886e38


def narrowest_types(df: DataFrame) -> dict[str, str]:
    """Smallest type per numeric column whose open bounds hold the column's range.

    A fractional column goes to float only if every value survives the round trip,
    so the step never changes a value.
    """
    columns = numeric_columns(df)
    kinds = {f.name: f.dataType for f in df.schema}
    whole = [c for c in columns if isinstance(kinds[c], (ByteType, ShortType, IntegerType, LongType))]
    real = [c for c in columns if isinstance(kinds[c], (FloatType, DoubleType))]
    stats = collect_stats(df, whole + real)
    out = {}
    for c in whole:
        if stats.low[c] is None:
            continue
        for kind, low, high in _INTEGERS:
            if low < stats.low[c] and stats.high[c] < high:
                out[c] = kind.simpleString()
                break
    if real:
        changed = df.agg(
            *[
                F.count_if(F.col(f"`{c}`").cast("float").cast("double") != F.col(f"`{c}`")).alias(f"c{i}")
                for i, c in enumerate(real)
            ]
        ).first()
        for i, c in enumerate(real):
            if stats.low[c] is None:
                continue
            fits = -_FLOAT_MAX < stats.low[c] and stats.high[c] < _FLOAT_MAX and changed[f"c{i}"] == 0
            out[c] = "float" if fits else "double"
    return out


def narrow(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in narrowest_types(df).items()})
