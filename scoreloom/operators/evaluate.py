"""Exact ROC AUC and stratified folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import running_totals

CUT_ROWS = 50_000


def roc_auc(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), name: str = "auc", hot_rows: int | None = None
) -> DataFrame:
    """Rank-sum AUC, ties counted half; one row, or one row per ``by`` group.

    Rows are first reduced to distinct scores; the running count of negatives
    over them is the only ordered step, and it is cut into range slices when the
    distinct scores are many. Groups with one class only get a missing AUC.
    """
    by = list(by)
    counts = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, score)
        .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    )
    upto = running_totals(counts, by, [F.col(score).asc()], {"_upto": F.col("_neg")}, hot_rows)
    wins = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return upto.groupBy(*by).agg(F.try_divide(wins, pairs).alias(name))


def _slot(seed: int, ids: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def stratified_folds(
    df: DataFrame, id: str, label: str = "TARGET", folds: int = 5, seed: int = 1, name: str = "fold"
) -> DataFrame:
    """Fold 0..folds-1 per labelled row: shuffled by hash, each class dealt out in turn.

    A class is one group of any size, so it is cut by leading digits of the hash that
    orders it, as many as keep a cut near ``CUT_ROWS`` rows. Rows are numbered
    inside each cut; the cut sizes carry the numbering on.
    """
    rows = df.filter(F.col(label).isNotNull()).withColumn("_h", _slot(seed, [id]))
    digits = max(1, math.ceil(math.log(max(rows.count(), 1) / CUT_ROWS, 16)))
    rows = rows.withColumn("_cut", F.substring("_h", 1, digits))
    sizes = rows.groupBy(label, "_cut").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(label).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(label, "_cut", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(label, "_cut").orderBy("_h", id)) + F.col("_before")
    dealt = rows.join(before, [label, "_cut"])
    return dealt.select(*df.columns, F.pmod(place - 1, F.lit(folds)).cast("int").alias(name))
