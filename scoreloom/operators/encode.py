"""Label and one-hot encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from .profile import distinct_counts, distinct_values, string_columns
from .skew import running_totals

#: Categories up to which codes are part of the projection; beyond it they come by a join. Both give the same rows.
INLINE = 1_000


def code_table(df: DataFrame, column: str) -> DataFrame:
    """(column, code): sorted distinct values numbered from 0.

    The numbers are a running count over the distinct values, taken slice by
    slice when there are very many of them.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    coded = running_totals(values, [], [F.col(column).asc()], {"code": F.lit(1)})
    return coded.select(column, (F.col("code") - 1).cast("int").alias("code"))


def _inline_codes(column: str, values: Sequence, kind: str) -> Column:
    """Code as part of the projection: position in a constant sorted array of the column's type."""
    known = F.array(*[F.lit(v).cast(kind) for v in values])
    return F.coalesce(F.array_position(known, F.col(column)) - 1, F.lit(-1)).cast("int")


def label_encode(df: DataFrame, columns: Sequence[str] | None = None, skip: Sequence[str] = ("TARGET",)) -> DataFrame:
    """Replace string columns by the rank of their value; missing becomes -1.

    Columns with few values (the usual case) are encoded inside the projection.
    Larger ones join their code table, which Spark broadcasts or shuffles by size.
    """
    columns = string_columns(df, skip) if columns is None else list(columns)
    if not columns:
        return df
    sizes = distinct_counts(df, columns, up_to=INLINE)
    small = [c for c in columns if sizes[c] <= INLINE]
    if small:
        lists = values_of(df, small)
        kinds = dict(df.dtypes)
        df = df.withColumns({c: _inline_codes(c, lists[c], kinds[c]) for c in small})
    for c in columns:
        if c not in small:
            df = df.join(code_table(df, c), c, "left").withColumn(c, F.coalesce("code", F.lit(-1))).drop("code")
    return df


def values_of(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values of columns already known to have few, typed as in the frame."""
    kinds = dict(df.dtypes)
    found: dict[str, list] = {c: [] for c in columns}
    for r in distinct_values(df, columns).collect():
        found[r["column"]].append(_typed(r["text"] if r["number"] is None else r["number"], kinds[r["column"]]))
    return {c: sorted(v) for c, v in found.items()}


def _typed(value, kind: str):
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int(value)
    if kind.startswith("decimal"):
        return Decimal(value)
    return bool(value) if kind == "boolean" else value


def label_encode_few(
    df: DataFrame, low: int = 5, high: int = 20, skip: Sequence[str] = ("TARGET",)
) -> DataFrame:
    """Label-encode every column, of any type, that has low..high distinct values."""
    columns = [c for c in df.columns if c not in skip]
    sizes = distinct_counts(df, columns, up_to=high)
    chosen = [c for c in columns if low <= sizes[c] <= high]
    lists = values_of(df, chosen) if chosen else {}
    kinds = dict(df.dtypes)
    return df.withColumns({c: _inline_codes(c, lists[c], kinds[c]) for c in chosen})


def one_hot_plan(
    df: DataFrame, low: int = 2, high: int = 4, exclude: Sequence[str] = (), label: str = "TARGET"
) -> dict[str, list]:
    """Columns with low..high distinct values and those values."""
    columns = [c for c in df.columns if c != label and c not in exclude]
    sizes = distinct_counts(df, columns, up_to=high)
    chosen = [c for c in columns if low <= sizes[c] <= high]
    return values_of(df, chosen) if chosen else {}


def one_hot_encode(
    df: DataFrame,
    nan_as_category: bool = False,
    exclude: Sequence[str] = (),
    plan: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Replace the chosen columns by ``{column}_{value}`` 0/1 columns."""
    plan = one_hot_plan(df, exclude=exclude) if plan is None else plan
    kept = [F.col(f"`{c}`") for c in df.columns if c not in plan]
    coded = []
    for c, values in plan.items():
        coded += [F.col(f"`{c}`").eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}") for v in values]
        if nan_as_category:
            coded.append(F.col(f"`{c}`").isNull().cast("int").alias(f"{c}_nan"))
    return df.select(*kept, *coded)


def categorical_hints(df: DataFrame, columns: Sequence[str], most: int = 20) -> list[str]:
    """Whole-number columns with at most ``most`` distinct values."""
    whole = [c for c in columns if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint")]
    sizes = distinct_counts(df, whole, up_to=most)
    return [c for c in whole if sizes[c] <= most]
