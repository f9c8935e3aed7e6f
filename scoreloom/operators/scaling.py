"""Mean fill, scaling, log and the full preparation recipe before a model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import finite_frame
from .clean import incomplete_columns
from .encode import label_encode
from .profile import Stats, collect_stats, numeric_columns

KEEP = ("SK_ID_CURR", "TARGET")


def _value(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _filled(c: str, stats: Stats) -> Column:
    mean = stats.mean[c]
    return _value(c) if mean is None else F.coalesce(_value(c), F.lit(float(mean)))


def _apply(df: DataFrame, columns: Sequence[str] | None, rule) -> DataFrame:
    columns = numeric_columns(df, KEEP) if columns is None else list(columns)
    stats = collect_stats(df, columns)
    return df.withColumns({c: rule(c, stats) for c in columns})


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values become the column mean over all rows."""
    return _apply(df, columns, _filled)


def _spread(c: str, stats: Stats) -> Column:
    if stats.low[c] is None:
        return F.lit(None).cast("double")
    return F.lit(float(stats.high[c]) - float(stats.low[c]))


def min_max_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - min) / (max - min) after mean fill; a constant column becomes missing."""

    def rule(c, s):
        return F.try_divide(_filled(c, s) - F.lit(None if s.low[c] is None else float(s.low[c])), _spread(c, s))

    return _apply(df, columns, rule)


def norm_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / (max - min) after mean fill; a constant column becomes missing."""

    def rule(c, s):
        return F.try_divide(_filled(c, s) - F.lit(s.mean[c]), _spread(c, s))

    return _apply(df, columns, rule)


def log_plus_one(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """ln(x + 1), missing at and below -1; columns that are not numbers are dropped."""
    columns = numeric_columns(df, KEEP) if columns is None else list(columns)
    kept = [c for c in df.columns if c in KEEP or c in numeric_columns(df)]
    logs = {c: F.when(_value(c) > -1, F.ln(_value(c) + 1)) for c in columns}
    return df.select(*kept).withColumns(logs)


def standardise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population standard deviation; 0 for a constant column."""
    columns = numeric_columns(df, KEEP) if columns is None else list(columns)
    row = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()

    def rule(i, c):
        return (_value(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)

    return df.withColumns({c: rule(i, c) for i, c in enumerate(columns)})


SCALERS = {"norm": [norm_scale], "min_max": [min_max_scale], "norm_min_max": [norm_scale, min_max_scale], "none": []}


@dataclass
class Prepared:
    """A table ready for a learner: id, label (null = score only) and complete features."""

    frame: DataFrame
    features: list[str]
    id: str = "SK_ID_CURR"
    label: str = "TARGET"

    @property
    def labelled(self) -> DataFrame:
        return self.frame.filter(F.col(self.label).isNotNull())


def _at_minus_one(df: DataFrame) -> list[str]:
    """Columns whose logarithm is infinite somewhere, as a text column with a missing value is (code -1)."""
    columns = numeric_columns(df, KEEP)
    if not columns:
        return []
    row = df.agg(*[F.count_if(_value(c) == -1).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"n{i}"]]


def prepare(df: DataFrame, scaler: str = "norm", log: bool = False) -> Prepared:
    """inf -> null, scale, label-encode strings, optional log, mean fill, drop incomplete columns.

    With ``log`` a column that holds -1 is dropped: its logarithm is infinite, which the mean doesn't fill.
    Values below -1 have no logarithm and are filled.

    Each statistics pass is one aggregate over the table; the data itself is only
    ever projected, never shuffled.
    """
    df = finite_frame(df)
    numbers = numeric_columns(df, KEEP)
    for step in SCALERS[scaler]:
        df = step(df, numbers)
    df = label_encode(df, skip=KEEP)
    if log:
        df = df.drop(*_at_minus_one(df))
        df = log_plus_one(df)
    features = [c for c in df.columns if c not in KEEP]
    df = fill_mean(df, features)
    gone = incomplete_columns(df, features)
    df = df.drop(*gone)
    return Prepared(df, [c for c in features if c not in gone])
