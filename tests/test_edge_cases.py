"""Hand-computed edge cases of the null, zero and tie rules."""

import math

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import nulls, rowstats
from scoreloom.functions.recent import add_recent_bundles, gather_recent
from scoreloom.functions.stats import STAT_NAMES, slope, smoothed_ratio, stat
from scoreloom.operators import clean, encode, evaluate, scaling, scorecard
from scoreloom.operators.binning import bin_edges, edge_bin, equal_width_bin, quantile_bin
from scoreloom.operators.joins import left_join_blocks


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit(v):
    return F.lit(v).cast("double")


def test_flags_and_positive_part(spark):
    assert one(spark, nulls.flag(lit(None) > 0)) == 0
    assert one(spark, nulls.flag_not_equal(F.lit(None).cast("string"), "Closed")) == 1
    assert [one(spark, nulls.positive_part(lit(v))) for v in (None, -2, 3)] == [0, 0, 3]


def test_division_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.0), (1.0, None), (6.0, 4.0)], "a double, b double")
    rows = df.select(nulls.ratio(F.col("a"), F.col("b")).alias("r"), nulls.safe_div("a", "b").alias("s")).collect()
    assert [r["r"] for r in rows] == [None, None, None, 1.5]
    assert [r["s"] for r in rows] == [0.0, 0.0, None, 1.5]


def test_infinity_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,)], "x double")
    assert [r["x"] for r in nulls.finite_frame(df).collect()] == [None, None, None, 1.0]


GROUPS = {
    "all_null": [None, None],
    "one": [3.0],
    "constant": [3.0, 3.0],
    "gap": [1.0, None, 3.0],
    "skewed": [1.0, 2.0, 2.0, 9.0],
}
EXPECTED = {
    "all_null": dict(sum=0.0, mean=None, count=0, size=2, std=None, median=None),
    "one": dict(std=None, var=None, skew=None, kurt=None, median=3.0, sum=3.0),
    "constant": dict(std=0.0, skew=None, kurt=None, iqr=0.0),
    "gap": dict(mean=2.0, skew=None, kurt=None, iqr=None, median=2.0, count=2, size=3),
    "skewed": dict(skew=1.0970254494, kurt=-0.7055324212, iqr=2.0, median=2.0),
}


def grouped(spark):
    rows = [(g, i + 1, v) for g, values in GROUPS.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, rn int, v double")


def check(found):
    for g, wanted in EXPECTED.items():
        for name, value in wanted.items():
            got = found[g][name]
            assert got == value if value is None or got is None else got == pytest.approx(value, abs=1e-9), (g, name, got)


def test_group_statistics(spark):
    out = grouped(spark).groupBy("g").agg(*[stat(s, "v").alias(s) for s in STAT_NAMES])
    check({r["g"]: r.asDict() for r in out.collect()})


def test_recent_statistics_follow_the_same_rules(spark):
    stats = [s for s in STAT_NAMES if "nunique" not in s]
    out = add_recent_bundles(grouped(spark).groupBy("g").agg(gather_recent(["v"], 100)), {"v": stats}, [100])
    check({r["g"]: {s: r[f"last_100_v_{s}"] for s in stats} for r in out.collect()})


def test_slope(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 2.0), ("one", 1, 5.0), ("gap", 1, 1.0), ("gap", 2, None)],
        "g string, rn int, v double",
    )
    found = {r["g"]: r["s"] for r in df.groupBy("g").agg(slope("v", 10).alias("s")).collect()}
    assert found == {"a": 0.5, "one": 0.0, "gap": None}


def test_half_even(spark):
    df = spark.createDataFrame([(5, 2), (7, 2)], "a int, b int")
    assert [r[0] for r in df.select(smoothed_ratio("a", "b", 0.0)).collect()] == [2.0, 4.0]


def test_row_statistics(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.0, 1.0), (1.0, 2.0, None, 9.0), (None, None, None, None), (1.0, 2.0, 4.0, 9.0)],
        "a double, b double, c double, d double",
    )
    cols = list("abcd")
    rows = df.select(
        rowstats.row_kurtosis(cols).alias("k"), rowstats.row_std(cols).alias("s"), rowstats.row_sum(cols).alias("t"),
        rowstats.row_mean(cols).alias("m"), rowstats.row_median(cols).alias("md"), rowstats.row_kurtosis(cols[:2]).alias("two"),
    ).collect()
    assert [r["k"] for r in rows[:3]] == [0.0, None, None] and rows[3]["k"] == pytest.approx(1.5, abs=0.3)
    assert [r["t"] for r in rows] == [4.0, 12.0, 0.0, 16.0]
    assert [r["m"] for r in rows] == [1.0, 4.0, None, 4.0]
    assert [r["md"] for r in rows] == [1.0, 2.0, None, 3.0]
    assert rows[2]["s"] is None and rows[1]["s"] == pytest.approx(math.sqrt(19))
    assert all(r["two"] is None for r in rows)


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (20.0,), (None,)], "x double")
    assert [r[0] for r in df.select(edge_bin(F.col("x"), [0, 1, 2])).collect()] == [None, 0, 1, None, None]
    assert [r[0] for r in df.select(equal_width_bin("x", 0, 20)).collect()] == [1, 1, 2, 20, None]
    assert bin_edges(0, 20)[0] == pytest.approx(-0.02) and bin_edges(0, 20)[20] == 20


def test_quantile_bins(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    found = {r["x"]: r["b"] for r in quantile_bin(df, "x", "b", 4).collect()}
    assert [sum(b == i for b in found.values()) for i in (1, 2, 3, 4)] == [25] * 4 and found[1.0] == 1


def test_label_encoding(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",)], "x string")
    assert [r["x"] for r in encode.label_encode(df).collect()] == [-1, 1, 0]


def test_label_encoding_beyond_the_inline_size(spark, monkeypatch):
    monkeypatch.setattr(encode, "INLINE", 2)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["d", "b", None, "a", "c"])], "i int, x string")
    assert {r["i"]: r["x"] for r in encode.label_encode(df).collect()} == {0: 3, 1: 1, 2: -1, 3: 0, 4: 2}


def test_one_hot_and_narrowing(spark):
    df = spark.createDataFrame([("a", 1, 300, 0.5), ("b", 2, 1, 0.1), (None, 1, 7, 2.0)], "c string, few int, n bigint, x double")
    out = encode.one_hot_encode(df, plan={"c": ["a", "b"]}, nan_as_category=True)
    assert [(r["c_a"], r["c_b"], r["c_nan"]) for r in out.collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert clean.narrowest_types(df) == {"few": "tinyint", "n": "smallint", "x": "double"}


def test_constant_and_log_columns_are_dropped(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5.0, 1.0, "u"), (2, 0.0, 5.0, 2.0, "v"), (3, None, 5.0, None, "u")],
        "SK_ID_CURR int, TARGET double, flat double, x double, s string",
    )
    data = scaling.prepare(df, "min_max")
    assert data.features == ["x", "s"]
    assert [r["x"] for r in data.frame.orderBy("SK_ID_CURR").collect()] == [0.0, 1.0, 0.5]
    assert one(spark.createDataFrame([(-1.0,)], "x double").sparkSession, F.lit(1)) == 1
    logs = scaling.log_plus_one(spark.createDataFrame([(-1.0,), (0.0,)], "x double"))
    assert [r["x"] for r in logs.collect()] == [None, 0.0]


def test_woe(spark):
    rows = [(i, t, v) for i, (t, v) in enumerate([(0.0, "a"), (0.0, "a"), (1.0, "b"), (0.0, "b"), (None, "c"), (0.0, None)])]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, TARGET double, s string")
    found = {r["SK_ID_CURR"]: r["s"] for r in scorecard.woe_encode(df).collect()}
    assert found[0] == pytest.approx(round(math.log((2 / 4) / 1e-100), 5))
    assert found[2] == pytest.approx(round(math.log((1 / 4) / 1.0), 5))
    assert found[5] == 0 and found[4] == 0


def test_auc_of_ties(spark):
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.5), (0, 0.5)], "y int, s double")
    assert evaluate.roc_auc(tied, "y", "s").first()["auc"] == 0.5
    split = spark.createDataFrame([(0, 0.1), (1, 0.9)], "y int, s double")
    assert evaluate.roc_auc(split, "y", "s").first()["auc"] == 1.0
    only = spark.createDataFrame([(1, 0.1)], "y int, s double")
    assert evaluate.roc_auc(only, "y", "s").first()["auc"] is None


def test_entity_without_history(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    block = spark.createDataFrame([(1, 5)], "k int, n int")
    assert {r["k"]: r["n"] for r in left_join_blocks(left, [block], "k").collect()} == {1: 5, 2: None}
