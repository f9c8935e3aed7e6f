"""Ordered work on keys of any size.

A window over one key runs in one task, which is right for ordinary keys and
wrong for a key that holds a large part of the table. Every ordered operator of
this package therefore asks ``split_hot`` first. Ordinary keys take the plain
window (one exchange). The few hot keys are range-partitioned by their order
into slices; each slice is ranked on its own and the small per-slice totals
carry the running state from slice to slice. Both ways give the same rows.

``HOT_ROWS`` (or ``scoreloom.hotRows``) only chooses the way, never the rows of the
result. Hot keys stay a table, and the number of slices follows the number of hot
rows; both, and the slice totals, are joined the way Spark finds best for their size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

HOT_ROWS = 2_000_000
_SLICE = "_slice"


def hot_limit(df: DataFrame, hot_rows: int | None = None) -> int:
    """Rows from which a key counts as hot; ``scoreloom.hotRows`` in the session overrides."""
    return int(hot_rows or df.sparkSession.conf.get("scoreloom.hotRows", str(HOT_ROWS)))


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int | None = None
) -> tuple[DataFrame, DataFrame | None, int]:
    """(ordinary rows, hot rows or None, number of hot rows).

    The count per key is a map-side combined aggregate over the key columns
    alone; the hot keys are written once and only their number reaches the driver.
    """
    limit = hot_limit(df, hot_rows)
    if not keys:
        rows = df.count()
        return (df.limit(0), df, rows) if rows > limit else (df, None, 0)
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    rows = found.agg(F.sum("_rows")).first()[0]
    if not rows:
        return df, None, 0
    names = cut_lineage(found).drop("_rows")
    same = F.lit(True)
    for k in keys:  # a missing key is a group too
        same = same & df[k].eqNullSafe(names[k])
    return df.join(names, same, "left_anti"), df.join(names, same, "left_semi"), rows


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int, limit: int) -> DataFrame:
    """Rows in (keys, order) ranges of about ``limit / 2`` rows, slice number stored.

    The slice is the range partition a row went to. It is written to the
    shared folder with the row, so every later reading, also after a lost
    executor, sees the same slices.
    """
    parts = max(2, math.ceil(2 * rows / limit))
    placed = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut_lineage(placed.withColumn(_SLICE, F.spark_partition_id()))


def _carried(slices: DataFrame, keys: Sequence[str], totals: list[Column], carry: Callable) -> DataFrame:
    small = slices.groupBy(*keys, _SLICE).agg(*totals)
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    return small.select(*keys, _SLICE, *carry(across))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    hot_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sum of each ``totals`` expression per key, in ``order``."""
    limit = hot_limit(df, hot_rows)
    cold, hot, rows = split_hot(df, keys, hot_rows)
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cold.select("*", *[F.sum(v).over(here).alias(n) for n, v in totals.items()])
    if hot is None:
        return out
    slices = _slices(hot, keys, order, rows, limit)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def carry(across):
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in totals]

    before = _carried(slices, keys, [F.sum(v).alias(f"_t_{n}") for n, v in totals.items()], carry)
    ranked = slices.join(before, [*keys, _SLICE]).select(
        *df.columns, *[(F.sum(v).over(inside) + F.col(f"_b_{n}")).alias(n) for n, v in totals.items()]
    )
    return ranked if not keys else out.unionByName(ranked)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    rank: str | None = "rn",
    newest: Iterable[str] = (),
    previous: Iterable[str] = (),
    hot_rows: int | None = None,
) -> list[DataFrame]:
    """Rows with their place in the key's order; ordinary and hot keys as separate frames.

    ``rank`` numbers the rows from 1, ``newest_{c}`` repeats the first row's value
    of ``c`` on every row, ``previous_{c}`` is the value on the row before.
    The frames hold disjoint keys, so a per-key summary of each one can simply be
    united (``summarise``) and an ordinary key is exchanged only once.
    """
    newest, previous = list(newest), list(previous)
    limit = hot_limit(df, hot_rows)
    cold, hot, rows = split_hot(df, keys, hot_rows)
    here = Window.partitionBy(*keys).orderBy(*order)
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    frames = [
        cold.select(
            "*",
            *([F.row_number().over(here).alias(rank)] if rank else []),
            *[F.first(c).over(whole).alias(f"newest_{c}") for c in newest],
            *[F.lag(c).over(here).alias(f"previous_{c}") for c in previous],
        )
    ]
    if hot is None:
        return frames

    slices = _slices(hot, keys, order, rows, limit)
    local = slices.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys, _SLICE).orderBy(*order))
    )
    ends = [
        F.count(F.lit(1)).alias("_size"),
        *[F.min_by(F.struct(c), "_n").alias(f"_head_{c}") for c in newest],
        *[F.max_by(F.struct(c), "_n").alias(f"_tail_{c}") for c in previous],
    ]

    def carry(across):
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        return [
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
            *[F.first(f"_head_{c}").over(across)[c].alias(f"newest_{c}") for c in newest],
            *[F.lag(f"_tail_{c}").over(across)[c].alias(f"_tail_{c}") for c in previous],
        ]

    joined = local.join(_carried(local, keys, ends, carry), [*keys, _SLICE])
    inside = Window.partitionBy(*keys, _SLICE).orderBy("_n")
    frames.append(
        joined.select(
            *df.columns,
            *([(F.col("_n") + F.col("_before")).alias(rank)] if rank else []),
            *[F.col(f"newest_{c}") for c in newest],
            *[
                F.when(F.col("_n") == 1, F.col(f"_tail_{c}"))
                .otherwise(F.lag(c).over(inside))
                .alias(f"previous_{c}")
                for c in previous
            ],
        )
    )
    return frames


def summarise(
    frames: Sequence[DataFrame],
    keys: Sequence[str],
    aggregates: Sequence[Column],
    distinct: Mapping[str, str] | None = None,
) -> DataFrame:
    """The same per-key aggregates over each frame, united (the frames share no key).

    ``distinct`` (name -> column) adds distinct counts. On ordinary keys, whose rows
    are bounded, they are taken from a set inside the same aggregate; a plain
    ``count(DISTINCT)`` would copy every row once per counted column. Hot keys use
    the distributed form.
    """
    sets = [f"size(collect_set(`{c}`))" for c in (distinct or {}).values()]
    counts = [f"count(DISTINCT `{c}`)" for c in (distinct or {}).values()]
    parts = []
    for place, frame in enumerate(frames):
        texts = sets if place == 0 else counts
        extra = [F.expr(t).cast("bigint").alias(n) for t, n in zip(texts, distinct or {})]
        parts.append(frame.groupBy(*keys).agg(*aggregates, *extra))
    return reduce(DataFrame.unionByName, parts)


def united(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per key, nulls skipped.

    Ordinary keys use the ``percentile`` aggregate, whose buffer is the key's
    distinct values. For hot keys the distinct values are counted, their running
    count is taken slice by slice and the two neighbours of each wanted position
    are picked by one aggregate.
    """
    limit = hot_limit(df, hot_rows)
    cold, hot, _ = split_hot(df.select(*keys, column), keys, hot_rows)
    cuts = F.percentile(F.col(column), F.array(*[F.lit(float(p)) for p in probabilities]))
    out = cold.groupBy(*keys).agg(cuts.alias("_p"))
    out = out.select(*keys, *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if hot is None:
        return out
    values = hot.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    # a hot key may still have few distinct values; slices follow the distinct ones
    upto = running_totals(values, keys, [F.col(column).asc()], {"_upto": F.col("_c")}, hot_rows=limit)
    size = hot.groupBy(*keys).agg(F.count(column).alias("_n"))
    if keys:
        placed = upto.join(size, list(keys))
    else:
        placed = upto.withColumn("_n", F.lit(size.first()["_n"]))
    picks = []
    for i, p in enumerate(probabilities):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        for side, place in (("l", F.floor(spot)), ("h", F.ceil(spot))):
            at = (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)
            picks.append(F.max(F.when(at, F.col(column).cast("double"))).alias(f"_{side}{i}"))
    picked = placed.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)

    def between(i, p):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        return F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (spot - F.floor(spot))

    picked = picked.select(
        *keys, *[between(i, p).alias(n) for i, (p, n) in enumerate(zip(probabilities, names))]
    )
    return out.unionByName(picked) if keys else picked


def percentiles_of_columns(
    df: DataFrame,
    keys: Sequence[str],
    names: Mapping[str, Sequence[str]],
    probabilities: Sequence[float],
    hot_rows: int | None = None,
) -> DataFrame:
    """``group_percentiles`` of several columns (column -> names): one count of the keys, one aggregate of the ordinary ones."""
    cold, hot, _ = split_hot(df.select(*keys, *names), keys, hot_rows)
    shares = F.array(*[F.lit(float(p)) for p in probabilities])
    out = cold.groupBy(*keys).agg(*[F.percentile(F.col(c), shares).alias(f"_p_{c}") for c in names])
    out = out.select(*keys, *[F.get(f"_p_{c}", F.lit(i)).alias(n) for c, ns in names.items() for i, n in enumerate(ns)])
    if hot is None:
        return out
    picked = [group_percentiles(hot, keys, c, probabilities, ns, hot_rows) for c, ns in names.items()]
    return out.unionByName(reduce(lambda a, b: a.join(b, list(keys)), picked))
