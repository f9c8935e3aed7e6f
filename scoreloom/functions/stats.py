"""Group statistics by name, each one a mergeable aggregate.

Statistics are built as SQL aggregate text with an optional ``FILTER (WHERE ...)``
condition, so one ``groupBy`` pass can hold the same statistic for many subsets
(last k rows, one segment, ...) and hundreds of columns are cheap to put together.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def _q(name: str) -> str:
    return f"`{name}`"


def _filter(where: str | None) -> str:
    return f" FILTER (WHERE {where})" if where else ""


def _rows(where: str | None) -> str:
    return f"count(1){_filter(where)}"


def _plain(function: str):
    return lambda v, w: f"{function}({v}){_filter(w)}"


def _sum(v: str, w: str | None) -> str:
    total = f"coalesce(cast(sum({v}){_filter(w)} AS DOUBLE), 0D)"
    return f"CASE WHEN {_rows(w)} > 0 THEN {total} END" if w else total


def _complete(v: str, w: str | None, result: str) -> str:
    """The statistic, or null as soon as one value of the subset is missing."""
    return f"CASE WHEN count({v}){_filter(w)} = {_rows(w)} THEN {result} END"


def _percentile(v: str, w: str | None, share: float) -> str:
    return f"percentile({v}, {share}){_filter(w)}"


_BUILDERS = {
    "sum": _sum,
    "mean": _plain("avg"),
    "max": _plain("max"),
    "min": _plain("min"),
    "std": _plain("stddev_samp"),
    "var": _plain("var_samp"),
    "count": _plain("count"),
    "size": lambda v, w: _rows(w),
    "nunique": lambda v, w: f"count(DISTINCT {v}){_filter(w)}",
    "approx_nunique": _plain("approx_count_distinct"),
    "median": lambda v, w: _percentile(v, w, 0.5),
    "skew": lambda v, w: _complete(v, w, _plain("skewness")(v, w)),
    "kurt": lambda v, w: _complete(v, w, _plain("kurtosis")(v, w)),
    "iqr": lambda v, w: _complete(v, w, f"{_percentile(v, w, 0.75)} - {_percentile(v, w, 0.25)}"),
}

STAT_NAMES = tuple(_BUILDERS)


def stat(name: str, column: str, where: str | None = None) -> Column:
    """One named statistic of a column over the rows matching ``where``."""
    return F.expr(_BUILDERS[name](_q(column), where))


def stat_bundle(column: str, stats: Iterable[str], prefix: str = "", where: str | None = None) -> list[Column]:
    """``{prefix}{column}_{stat}`` for every requested statistic."""
    return [stat(s, column, where).alias(f"{prefix}{column}_{s}") for s in stats]


def agg_spec(spec: Mapping[str, Iterable[str]], prefix: str = "", where: str | None = None) -> list[Column]:
    """``{column: [stats]}`` to aggregates named ``{prefix}{column}_{STAT}``."""
    return [stat(s, c, where).alias(f"{prefix}{c}_{s.upper()}") for c, names in spec.items() for s in names]


def share(condition: str) -> Column:
    """Share of the group's rows for which the condition holds."""
    return F.expr(f"avg(CASE WHEN {condition} THEN 1D ELSE 0D END)")


def slope(column: str, k: int | None = None, rank: str = "rn") -> Column:
    """Least-squares slope of the newest ``k`` values against 0, 1, 2, ...

    ``rank`` starts at 1 on the newest row. A single value has slope 0.0; one
    missing value inside the window makes the slope missing.
    """
    where = None if k is None else f"{rank} <= {k}"
    line = f"regr_slope(cast({_q(column)} AS DOUBLE), cast({rank} - 1 AS DOUBLE)){_filter(where)}"
    line = f"CASE WHEN {_rows(where)} = 1 THEN 0D ELSE {line} END"
    return F.expr(_complete(_q(column), where, line))


def smoothed_ratio(a: str, b: str, epsilon: float = 0.0001) -> Column:
    """a / (b + epsilon) rounded half to even."""
    return F.expr(f"bround({_q(a)} / ({_q(b)} + {epsilon}D), 0)")
