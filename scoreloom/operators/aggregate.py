"""Group aggregation operators; all of them combine map-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import tidy_value
from ..functions.stats import agg_spec


def aggregate(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Sequence[str]], prefix: str = "") -> DataFrame:
    """Dictionary-driven aggregation: ``{column: [stat, ...]}`` to ``{prefix}{column}_{STAT}``."""
    return df.groupBy(*keys).agg(*agg_spec(spec, prefix))


def entity_spine(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys of a history table."""
    return df.select(key).distinct()


def last_value(value: str, order: Sequence[str]) -> Column:
    """Value on the row that is last in ``order`` (which ends in a tie-break)."""
    return F.max_by(F.struct(value), F.struct(*order))[value]


def first_known_value(value: str, order: Sequence[str]) -> Column:
    """First non-missing value in ``order``."""
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    return F.min_by(F.col(value), place)


def arg_max_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str], prefix: str = "LATEST_") -> DataFrame:
    """Columns of the row that is greatest in ``order``, one row per key."""
    best = F.max_by(F.struct(*take), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(prefix + c) for c in take])


def value_count_columns(column: str, values: Sequence, prefix: str | None = None) -> list[Column]:
    """One count column per value, absent values count 0."""
    head = f"{column}_" if prefix is None else prefix
    return [
        F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(tidy_value(f"{head}{str(v).strip()}")) for v in values
    ]


def value_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """Counts per key of the given values, as columns."""
    return df.groupBy(*keys).agg(*value_count_columns(column, values))


def segment_columns(spec: Mapping[str, Sequence[str]], segments: Mapping[str, str | None]) -> list[Column]:
    """The same aggregates for several row segments, in one pass (prefix -> condition)."""
    return [c for prefix, where in segments.items() for c in agg_spec(spec, prefix, where)]


def two_level(
    df: DataFrame, outer: Sequence[str], inner: Sequence[str], inner_aggs: Sequence[Column], outer_aggs: Sequence[Column]
) -> DataFrame:
    """Aggregate per (outer, inner), then per outer."""
    return df.groupBy(*outer, *inner).agg(*inner_aggs).groupBy(*outer).agg(*outer_aggs)
