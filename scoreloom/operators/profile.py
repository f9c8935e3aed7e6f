"""Column statistics that later passes need, and the printed profiles as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

FEW = 20  # fixed value: most distinct values a categorical column may have
BLOCK = 100  # columns of one aggregate: four statistics of each still fit into one plan


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in skip
    ]


def string_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in skip]


@dataclass
class Stats:
    """Bounded driver-side statistics: one record per column."""

    rows: int
    low: dict
    high: dict
    mean: dict
    known: dict


def _number(df: DataFrame, c: str):
    kind = df.schema[c].dataType
    return F.col(f"`{c}`").cast("int") if isinstance(kind, BooleanType) else F.col(f"`{c}`")


def collect_stats(df: DataFrame, columns: Sequence[str]) -> Stats:
    """min, max, mean and non-missing count of every column, in the column's own type.

    Columns are taken in blocks, one aggregate each, which together read every
    column once.
    """
    columns = list(columns)
    low, high, mean, known, rows = {}, {}, {}, {}, None
    for at in range(0, max(len(columns), 1), BLOCK):
        block = columns[at : at + BLOCK]
        wanted = []
        for i, c in enumerate(block):
            v = _number(df, c)
            wanted += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.avg(v).alias(f"m{i}"), F.count(v).alias(f"n{i}")]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *wanted).first()
        rows = row["rows"]
        for i, c in enumerate(block):
            low[c], high[c], mean[c], known[c] = (row[f"{key}{i}"] for key in "lhmn")
    return Stats(rows, low, high, mean, known)


def _cells(df: DataFrame, columns: Sequence[str], kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., place, value): one row per cell, place = position in ``columns``."""
    values = ", ".join(f"CAST(`{c}` AS {kind})" for c in columns)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"posexplode(array({values})) AS (place, value)")


# Types whose values a double holds exactly; other columns travel as text.
_AS_DOUBLE = ("tinyint", "smallint", "int", "float", "double", "boolean")


def _by_carrier(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, list[str]]]:
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c] in _AS_DOUBLE]
    texts = [c for c in columns if kinds[c] not in _AS_DOUBLE]
    return [(kind, names) for kind, names in (("double", numbers), ("string", texts)) if names]


def distinct_counts(df: DataFrame, columns: Sequence[str], up_to: int | None = None) -> dict[str, int]:
    """Distinct non-missing values per column.

    A sketch over all columns comes first. Only columns whose sketch is within
    reach of ``up_to`` are counted exactly (they have few values, so the exact
    count shrinks to almost nothing before its exchange); the others keep the
    sketch value, which is then above ``up_to`` anyway. Without ``up_to`` every
    column is counted exactly.
    """
    columns = list(columns)
    found: dict[str, int] = {c: 0 for c in columns}
    exact = columns
    if up_to is not None:
        exact = []
        for kind, names in _by_carrier(df, columns):
            sketch = F.approx_count_distinct("value", 0.02).alias("n")
            for r in _cells(df, names, kind).groupBy("place").agg(sketch).collect():
                c = names[r["place"]]
                found[c] = max(r["n"], up_to + 1)
                if r["n"] <= 2 * up_to + 10:
                    exact.append(c)
    if exact:
        found.update({r["column"]: r["n"] for r in distinct_table(df, exact).collect()})
    return found


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, number, text): the distinct non-missing values, in the carrier that fits."""
    parts = []
    for kind, names in _by_carrier(df, columns):
        cells = _cells(df, names, kind).filter(F.col("value").isNotNull()).distinct()
        label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("place") + 1).alias("column")
        none = F.lit(None)
        number = F.col("value") if kind == "double" else none.cast("double")
        text = F.col("value") if kind == "string" else none.cast("string")
        parts.append(cells.select(label, number.alias("number"), text.alias("text")))
    return reduce(DataFrame.unionByName, parts)


def distinct_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n); a column without any value has n = 0."""
    counted = distinct_values(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(counted), "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, min, max, distinct, non-missing and missing count.

    Minimum and maximum are taken in the column's own order and shown as text.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    facts = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        facts += [F.min(v).cast("string").alias(f"l{i}"), F.max(v).cast("string").alias(f"h{i}"), F.count(v).alias(f"n{i}")]
    once = df.agg(F.count(F.lit(1)).alias("rows"), *facts)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"l{i}").alias("min"),
                    F.col(f"h{i}").alias("max"), F.col(f"n{i}").alias("count"),
                    (F.col("rows") - F.col(f"n{i}")).alias("isnull_sum"),
                )
                for i, c in enumerate(columns)
            ]
        )
    ).alias("r")
    distinct = distinct_table(df, columns).withColumnRenamed("n", "nunique")
    out = once.select(rows).select("r.*").join(distinct, "column", "left")
    return out.select(
        "column", "dtype", "min", "max", F.coalesce("nunique", F.lit(0)).alias("nunique"), "count", "isnull_sum"
    )


def transposed_head(df: DataFrame, order: Sequence, num: int = 1) -> DataFrame:
    """The first ``num`` rows, one output row per column, values ``row_1`` ... as text."""
    first = df.orderBy(*order).limit(num)
    numbered = first.select(
        F.row_number().over(_whole(order)).alias("_n"), *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    )
    cells = numbered.unpivot(["_n"], df.columns, "column", "value")
    return cells.groupBy("column").agg(
        *[F.max(F.when(F.col("_n") == i, F.col("value"))).alias(f"row_{i}") for i in range(1, num + 1)]
    )


def _whole(order):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # at most ``num`` rows reach this window


def first_rows_of(df: DataFrame, order: Sequence, num: int) -> DataFrame:
    """The first rows in a stated order (each task keeps ``num`` rows, then they merge)."""
    return df.orderBy(*order).limit(num)
