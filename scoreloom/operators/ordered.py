"""Ordered-history operators: last-k bundles, trends, steps, last-loan features.

``order`` is a list of sort expressions that ends in a tie-break, so the order
is total; the first row is the one to start counting from.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.naming import of_period
from ..functions.nulls import safe_div_sql
from ..functions.recent import add_recent_bundles, gather_recent
from ..functions.stats import slope, stat, stat_bundle
from .skew import ordered, summarise


# Statistics whose fractions need a divisor away from 0.
UNSTABLE = ("skew", "kurt")
SMALLEST_DIVISOR = 1e-9


def newest_first(column: str, *ties: str) -> list[Column]:
    """Descending by ``column`` and by each tie-break, missing values last."""
    return [F.col(c).desc_nulls_last() for c in (column, *ties)]


def oldest_first(column: str, *ties: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in (column, *ties)]


def whole_history_columns(bundles: Mapping[str, Iterable[str]], prefix: str = "all_installment_") -> list[Column]:
    return [c for column, stats in bundles.items() for c in stat_bundle(column, stats, prefix)]


def trend_columns(columns: Iterable[str], periods: Iterable[int], rank: str = "rn") -> list[Column]:
    columns = list(columns)
    return [
        slope(c, k, rank).alias(f"{k}_period_trend_{c}") for k in periods for c in columns
    ]


def last_loan_columns(
    bundles: Mapping[str, Iterable[str]], loan: str, prefix: str = "last_loan_"
) -> list[Column]:
    """Bundles over the rows of the newest row's loan (needs ``newest_{loan}``)."""
    where = f"{loan} <=> newest_{loan}"
    return [c for column, stats in bundles.items() for c in stat_bundle(column, stats, prefix, where)]


def fraction_columns(names: Sequence[str], short: int, long: int) -> list[str]:
    """Same-named statistics of a short window over those of a long one.

    Skewness and kurtosis near 0 are rounding noise; a fraction over them is missing.
    """
    out = []
    for a, b in zip(of_period(names, short), of_period(names, long)):
        name = a.replace(f"_{short}_", f"_{short}by{long}_fraction_")
        value = safe_div_sql(f"`{a}`", f"`{b}`")
        if a.endswith(UNSTABLE):
            value = f"CASE WHEN abs(`{b}`) >= {SMALLEST_DIVISOR} THEN {value} END"
        out.append(f"{value} AS `{name}`")
    return out


def last_k_statistics(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bundles, periods
) -> DataFrame:
    """Statistic bundles of the newest k rows per key, for every k in one pass.

    Only the longest window is exchanged: ``rank <= k`` is a group limit on the map side.
    """
    rows = top_rows(df, keys, order, max(periods))
    gathered = rows.groupBy(*keys).agg(gather_recent(list(bundles), max(periods)))
    return add_recent_bundles(gathered, bundles, periods)


def trends(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns, periods
) -> DataFrame:
    """Slopes over the newest k rows per key; rows beyond the longest k are not exchanged."""
    rows = top_rows(df, keys, order, max(periods))
    return rows.groupBy(*keys).agg(*trend_columns(columns, periods))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows per key with their rank.

    Spark plans ``rank <= k`` as a group limit before the exchange, so a map task
    sends at most k rows per key, however large the key.
    """
    here = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(here)).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in order (drop duplicates after a sort)."""
    return top_rows(df, keys, order, 1, "_rn").drop("_rn")


def tail_means(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], names: Mapping[str, str], counts: Iterable[int]
) -> DataFrame:
    """Mean over the last n rows per key; ``names`` maps column to a name with ``{n}``."""
    counts = list(counts)
    rows = top_rows(df, keys, order, max(counts))
    return rows.groupBy(*keys).agg(*tail_mean_columns(names, counts))


def tail_mean_columns(names: Mapping[str, str], counts: Iterable[int], rank: str = "rn") -> list[Column]:
    return [
        stat("mean", c, f"{rank} <= {n}").alias(name.format(n=n))
        for n in counts
        for c, name in names.items()
    ]


def mean_step(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, hot_rows: int | None = None
) -> DataFrame:
    """Mean difference to the row before, per key."""
    frames = ordered(df, keys, order, rank=None, previous=[value], hot_rows=hot_rows)
    return summarise(frames, keys, [F.avg(F.col(value) - F.col(f"previous_{value}")).alias(name)])


def last_loan(
    df: DataFrame, keys: Sequence[str], loan: str, order: Sequence[str], bundles, prefix: str = "last_loan_"
) -> DataFrame:
    """Statistics of the loan that holds the newest row, without a window.

    Two mergeable levels: per (key, loan), then the loan whose newest row is the
    newest of the key. ``order`` names the order column and its tie-breaks.
    """
    stats = [c for column, names in bundles.items() for c in stat_bundle(column, names, prefix)]
    names = [f"{prefix}{column}_{s}" for column, ss in bundles.items() for s in ss]
    per_loan = df.groupBy(*keys, loan).agg(*stats, F.max(F.struct(*order)).alias("_newest"))
    best = per_loan.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col("_newest")).alias("_best"))
    return best.select(*keys, *[F.col("_best")[n].alias(n) for n in names])
