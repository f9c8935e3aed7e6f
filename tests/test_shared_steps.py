"""Bundles from plain projections, a wide table of written blocks, trees walked in blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scoreloom.catalog.blocks import native_wide
from scoreloom.functions.recent import add_recent_bundles, gather_recent
from scoreloom.models import histograms

STATS = ["sum", "mean", "max", "min", "std", "var", "count", "size", "median", "iqr", "skew", "kurt"]


def test_bundles_have_no_nested_functions_and_right_values(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.repeat([1, 2, 3], [3, 12, 40]), "v": rng.normal(0, 5, 55).round(2)})
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    rows = spark.createDataFrame(pdf).withColumn("v", F.when(~((F.col("g") == 2) & (F.col("rn") == 4)), F.col("v")))
    out = add_recent_bundles(rows.groupBy("g").agg(gather_recent(["v"], 20)), {"v": STATS}, [2, 20])
    assert "transform(array(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.toPandas().set_index("g")
    for g, own in pdf.groupby("g"):
        for k in (2, 20):
            w = own.v[own.rn <= k]
            v = w.drop(w.index[3]) if g == 2 and k == 20 else w
            want = {"sum": v.sum(), "mean": v.mean(), "max": v.max(), "min": v.min(), "std": v.std(), "var": v.var(), "count": len(v), "size": len(w), "median": v.median()}
            whole = len(v) == len(w)
            d = v - v.mean()
            want["iqr"] = v.quantile(0.75) - v.quantile(0.25) if whole else np.nan
            want["skew"] = (d**3).mean() / (d**2).mean() ** 1.5 if whole else np.nan
            want["kurt"] = (d**4).mean() / (d**2).mean() ** 2 - 3 if whole else np.nan
            for s, x in want.items():
                np.testing.assert_allclose(float(got.loc[g, f"last_{k}_v_{s}"] if got.loc[g, f"last_{k}_v_{s}"] is not None else np.nan), x, atol=1e-9, err_msg=f"{g} {k} {s}")


def test_windows_are_cut_where_nulls_go_and_count_their_gaps(spark):
    """Cuts that stand alone become one generated method, too long to be compiled; ranks come in any order."""
    rows = spark.createDataFrame([(1, 3, None), (1, 1, 4.0), (1, 2, 1.0), (2, 1, None)], "g int, rn int, v double")
    gathered = rows.groupBy("g").agg(gather_recent(["v"], 3))
    assert "lambda" not in gathered._jdf.queryExecution().optimizedPlan().toString()
    out = add_recent_bundles(gathered, {"v": ["size", "count", "sum", "median", "iqr"]}, [1, 2, 5])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("slice(") == plan.count("filter(slice(") == 3
    got = {r.g: r.asDict() for r in out.collect()}
    want = {1: {1: (1, 1, 4.0, 4.0, 0.0), 2: (2, 2, 5.0, 2.5, 1.5), 5: (3, 2, 5.0, 2.5, None)}, 2: dict.fromkeys((1, 2, 5), (1, 0, 0.0, None, None))}
    for g, windows in want.items():
        for k, values in windows.items():
            assert tuple(got[g][f"last_{k}_v_{s}"] for s in ("size", "count", "sum", "median", "iqr")) == values, (g, k)


def test_history_blocks_are_written_before_the_joins(spark, sf):
    plan = native_wide(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_trees_walked_in_blocks_of_any_size(monkeypatch):
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 20, (300, 4)).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 1] > 18).astype(float)
    tree, row = np.repeat(np.arange(3), 300), np.tile(np.arange(300), 3)
    trees = histograms.grow(bins, row, tree, y[row], np.ones(900), np.ones(900), 3, histograms.Rule(depth=5, criterion="gini", node_share=0.5), rng, 20)
    node = np.broadcast_to(trees.roots, (300, 3)).copy()
    for _ in range(trees.depth):
        node = trees.left[node] + (bins[np.arange(300)[:, None], trees.feature[node]] > trees.cut[node])
    for size in (1, 7, 32_768):
        monkeypatch.setattr(histograms, "WALKED", size)
        for form in (np.ascontiguousarray, np.asfortranarray):
            np.testing.assert_array_equal(trees.leaves(form(bins), trees.roots), node)
