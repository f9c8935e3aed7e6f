"""Registered queries: the Spark job, the equivalent SQL and the result columns.

Column kinds: ``int``, ``str``, ``num`` (compared at single precision: sums of
doubles depend on the order of addition in their last digits) and ``flat``
(standardised values such as skewness or slopes, compared at four places). Both
engines apply the same rounding, after the operator, only for the comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NUDGE = 1.00000000037  # keeps exact halfway values from rounding differently
SHIFT = 0.0000017


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    columns: dict[str, str]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def kinds(text: str | Mapping[str, str]) -> dict[str, str]:
    """``"id:int name:str a,b,c:num"`` to a dict."""
    if not isinstance(text, str):
        return dict(text)
    out = {}
    for part in text.split():
        names, kind = part.rsplit(":", 1)
        out.update({n: kind for n in names.split(",")})
    return out


def query(name: str, columns: str | Mapping[str, str], sql: str | None = None):
    def keep(run):
        wanted = kinds(columns)
        REGISTRY[name] = Query(name, lambda spark, sf: shaped(run(spark, sf), wanted), wanted, sql and shaped_sql(sql, wanted))
        return run

    return keep


def shaped(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    def one(name, kind):
        c = f"`{name}`"
        if kind == "int":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "str":
            c = f"CAST({c} AS STRING)"
        elif kind == "num":
            c = f"CAST(CAST(CAST({c} AS DOUBLE) * {NUDGE}D AS FLOAT) AS DOUBLE)"
            c = f"CASE WHEN {c} = 0 THEN 0D ELSE {c} END"
        elif kind == "flat":
            c = f"ROUND(CAST({c} AS DOUBLE) + {SHIFT}D, 4)"
            c = f"CASE WHEN {c} = 0 THEN 0D ELSE {c} END"
        return f"{c} AS `{name}`"

    return df.selectExpr(*[one(n, k) for n, k in columns.items()])


def shaped_sql(inner: str, columns: Mapping[str, str]) -> str:
    def one(name, kind):
        c = f'q."{name}"'
        if kind == "int":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "str":
            c = f"CAST({c} AS VARCHAR)"
        elif kind == "num":
            c = f"CAST(CAST(CAST({c} AS DOUBLE) * CAST({NUDGE} AS DOUBLE) AS FLOAT) AS DOUBLE)"
            c = f"CASE WHEN {c} = 0 THEN CAST(0 AS DOUBLE) ELSE {c} END"
        elif kind == "flat":
            c = f"ROUND(CAST({c} AS DOUBLE) + CAST({SHIFT} AS DOUBLE), 4)"
            c = f"CASE WHEN {c} = 0 THEN CAST(0 AS DOUBLE) ELSE {c} END"
        return f'{c} AS "{name}"'

    picks = ",\n  ".join(one(n, k) for n, k in columns.items())
    return f"WITH q AS (\n{inner}\n)\nSELECT {picks}\nFROM q"
