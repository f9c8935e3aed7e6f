"""One key holds most rows: the sliced way must give what the plain window gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.catalog import standin as st
from scoreloom.operators import skew
from scoreloom.operators.evaluate import roc_auc
from scoreloom.operators.ordered import mean_step, newest_first, oldest_first
from scoreloom.plans.credit_card import credit_card_features
from scoreloom.plans.installments import installment_features
from scoreloom.plans.pos import pos_features
from scoreloom.plans.previous import previous_features

KEY = "SK_ID_CURR"


@pytest.fixture(scope="module")
def lopsided(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 60, n)),
            "t": rng.integers(0, 25, n),
            "i": np.arange(n),
            "v": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 40, n).astype(float)),
        }
    )
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df.persist()


def test_split_finds_the_hot_key(lopsided):
    _, df = lopsided
    cold, hot, rows = skew.split_hot(df, ["k"], 500)
    assert [r["k"] for r in hot.select("k").distinct().collect()] == [1]
    assert rows == hot.count() and cold.count() + rows == df.count()


def test_rank_newest_and_previous(lopsided):
    pdf, df = lopsided
    order = newest_first("t", "i")
    out = skew.united(skew.ordered(df, ["k"], order, newest=["i"], previous=["v"], hot_rows=300)).toPandas()
    want = pdf.sort_values(["t", "i"], ascending=False)
    want["rn"] = want.groupby("k").cumcount() + 1
    want["newest_i"] = want.groupby("k")["i"].transform("first")
    want["previous_v"] = want.groupby("k")["v"].shift()
    columns = ["k", "i", "rn", "newest_i", "previous_v"]
    left, right = (d.sort_values("i").reset_index(drop=True)[columns] for d in (out, want))
    pd.testing.assert_frame_equal(left, right, check_dtype=False)


def test_running_totals_with_and_without_keys(lopsided):
    pdf, df = lopsided
    for keys in (["k"], []):
        out = skew.running_totals(df, keys, oldest_first("t", "i"), {"s": F.col("t")}, hot_rows=300).toPandas()
        want = pdf.sort_values(["t", "i"])
        want["s"] = want.groupby(keys)["t"].cumsum() if keys else want["t"].cumsum()
        left, right = (d.sort_values("i")["s"].tolist() for d in (out, want))
        assert left == right


def test_percentiles(lopsided):
    pdf, df = lopsided
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = list("abcde")
    for hot_rows in (10, 300, 10_000):
        out = skew.group_percentiles(df, ["k"], "v", shares, names, hot_rows).toPandas().set_index("k").sort_index()
        want = pdf.groupby("k")["v"].quantile(shares).unstack()
        np.testing.assert_allclose(out[names].to_numpy(float), want.to_numpy(float))
        both = skew.percentiles_of_columns(df, ["k"], {"v": names, "t": list("fghij")}, shares, hot_rows).toPandas().set_index("k").sort_index()
        np.testing.assert_allclose(both[names].to_numpy(float), want.to_numpy(float))
        np.testing.assert_allclose(both[list("fghij")].to_numpy(float), pdf.groupby("k")["t"].quantile(shares).unstack().to_numpy(float))
    row = skew.group_percentiles(df, [], "v", shares, names, 5).collect()
    assert len(row) == 1
    np.testing.assert_allclose([row[0][n] for n in names], pdf["v"].quantile(shares).to_numpy())


def test_mean_step(lopsided):
    pdf, df = lopsided
    out = mean_step(df, ["k"], oldest_first("t", "i"), "v", "m", hot_rows=200).toPandas().set_index("k").sort_index()
    want = pdf.sort_values(["t", "i"]).groupby("k")["v"].apply(lambda s: s.diff().mean())
    np.testing.assert_allclose(out["m"], want)


def test_auc_in_slices(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 3000), "s": np.round(rng.random(3000), 3)})
    df = spark.createDataFrame(pdf)
    a, b = pdf.s[pdf.y == 1].to_numpy()[:, None], pdf.s[pdf.y == 0].to_numpy()[None, :]
    want = (a > b).mean() + (a == b).mean() / 2
    for hot_rows in (50, 100_000):
        assert roc_auc(df, "y", "s", hot_rows=hot_rows).first()["auc"] == pytest.approx(want)


@pytest.mark.parametrize("block", ["installments", "previous", "pos", "credit_card"])
def test_feature_blocks_agree(spark, sf, block):
    native = st.Native(spark, sf)
    build = {
        "installments": lambda hot: installment_features(native.installments(), st.INSTALLMENT_TIES, all_history=True, hot_rows=hot),
        "previous": lambda hot: previous_features(native.previous(), hot_rows=hot),
        "pos": lambda hot: pos_features(native.pos(), ["event_id"], st.POS_STATUSES, hot_rows=hot),
        "credit_card": lambda hot: credit_card_features(native.credit_card(), ["event_id"], hot_rows=hot),
    }[block]
    limit = {"installments": 45, "previous": 12, "pos": 70, "credit_card": 70}[block]
    plain, sliced = (build(h).toPandas().set_index(KEY).sort_index() for h in (10**9, limit))
    fractions = [c for c in plain if "fraction" in c and ("skew" in c or "kurt" in c)]
    plain, sliced = plain.drop(columns=fractions), sliced.drop(columns=fractions)
    assert list(plain.columns) == list(sliced.columns)
    np.testing.assert_allclose(sliced.to_numpy(float), plain.to_numpy(float), rtol=1e-9, atol=1e-9)
