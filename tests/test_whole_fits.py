"""Fits learn from every labelled row, in blocks and files where the rows are many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.models import ensembles, histograms
from scoreloom.operators.scaling import Prepared
from scoreloom.session import cut_lineage


@pytest.fixture(scope="module")
def large(spark):
    """Only the rows behind the first 200,000 in the order of their ids' hash have x = 1, and most of them label 1."""
    cut = spark.range(250_000).orderBy(F.xxhash64("id")).limit(200_000).agg(F.max(F.xxhash64("id"))).first()[0]
    rows = spark.range(250_000).select(
        F.col("id").alias("SK_ID_CURR"), (F.xxhash64("id") > cut).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("rest")
    )
    label = F.when(F.col("SK_ID_CURR") % 10 == 0, F.lit(0.0)).when(F.col("x") == 1, F.lit(1.0)).otherwise((F.col("SK_ID_CURR") % 3 == 0).cast("double"))
    return Prepared(cut_lineage(rows.withColumn("TARGET", label)), ["x", "rest"])


def _crossed(data, name):
    return ensembles.forest_learner(data.features, trees=3)(data.labelled)(data.frame, name).select("SK_ID_CURR", name)


def _boosted(preset):
    return lambda d, name: ensembles.boosted_trees(d, preset, rounds=2).scores.select("SK_ID_CURR", F.col("average").alias(name))


@pytest.mark.parametrize(
    "learn",
    [
        ensembles.decision_tree,
        lambda d, name: ensembles.ada_boosted(d, name, rounds=2),
        lambda d, name: ensembles.random_forest(d, name, trees=3),
        lambda d, name: ensembles.bagged_trees(d, name, trees=20),
        _crossed,
        _boosted("catboost"),
        _boosted("gradient_boosting"),
        _boosted("lightgbm"),
    ],
)
def test_rows_with_late_hashes_are_learned(large, learn):
    means = learn(large, "p").join(large.frame, "SK_ID_CURR").groupBy("x").agg(F.avg("p")).collect()
    low, high = (m for _, m in sorted(means))
    assert high > low + 1e-3


def test_importances_count_rows_with_late_hashes(large):
    shares = {r["feature"]: r["importance"] for r in ensembles.forest_importances(large.labelled, large.features, trees=3).collect()}
    assert shares["x"] > 0.9


def test_one_split_has_the_means_of_all_rows(large):
    scores = ensembles.decision_tree(large, "p", histograms.Rule(depth=1, criterion="entropy")).join(large.frame, "SK_ID_CURR")
    for r in scores.groupBy("x").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.avg("TARGET").alias("mean")).collect():
        assert r["low"] == r["high"] == pytest.approx(r["mean"], abs=1e-12)


@pytest.mark.parametrize("hot", [None, "50"])
def test_edges_are_those_of_all_values(spark, monkeypatch, hot):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 300, 900) * 0.5, rng.integers(0, 5, 900) - 2.0, np.zeros(900), np.where(rng.random(900) < 0.9, np.nan, rng.normal(size=900)), np.full(900, np.nan)])
    frame = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(6)])).repartition(5)
    frame = frame.withColumns({c: F.when(F.isnan(c) & (F.rand(1) < 0.5), None).otherwise(F.col(c)) for c in frame.columns})
    monkeypatch.setattr(ensembles, "EDGED", 4)
    if hot:
        spark.conf.set("scoreloom.hotRows", hot)
    try:
        for bins in (3, 64):
            want, found = histograms.quantile_edges(x, bins), ensembles._edges(frame, [F.col(c) for c in frame.columns], bins)
            assert [e.tolist() for e in want] == [e.tolist() for e in found]
    finally:
        spark.conf.unset("scoreloom.hotRows")


def test_tasks_get_every_row_in_the_order_of_its_hash(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": [f"r{i // 2}" for i in range(700)], "y": np.where(rng.random(700) < 0.2, np.nan, rng.integers(0, 2, 700)), "a": rng.normal(size=700), "b": rng.integers(0, 4, 700) * 1.0})
    frame = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None).cast("double"))).repartition(4)
    found = ensembles.training(frame, ["a", "b"], "id", "y", 16)
    got = found.tasks(3, lambda k, s: (k, s.bins.copy(), s.y.copy()))
    want = frame.filter("y IS NOT NULL").orderBy(F.xxhash64("id"), "id").toPandas()
    assert [k for k, _, _ in got] == [0, 1, 2]
    for _, bins, y in got:
        assert len(y) == len(want) and y.sum() == want.y.sum()
        whole = histograms.binned(want[["a", "b"]].to_numpy(), found.edges)
        for i in want.index[~want.id.duplicated(keep=False)]:
            assert y[i] == want.y[i] and (bins[i] == whole[i]).all()
        assert sorted(map(tuple, bins)) == sorted(map(tuple, whole))


def test_blocks_and_files_give_the_same_models(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2048, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=2048) > 0).astype(float)
    bins = np.asfortranarray(histograms.binned(x, histograms.quantile_edges(x, 12)))
    rule, held = histograms.Rule(depth=4, l2=1.0, min_leaf=20), np.arange(2048) % 5 == 0

    def made():
        boosted, base, history = histograms.boost(bins, y, held, rule, np.random.default_rng(0), 12, 4, 0.3, 0.7, patience=9)
        ada = histograms.ada_boost(bins, y, histograms.Rule(depth=3, criterion="gini", min_leaf=20), np.random.default_rng(0), 12, 4)
        at, times = ensembles._drawn(np.random.default_rng(1), 2048, 2048)
        return boosted.total(bins), base, history, ada.mean(bins), at.tolist(), times.tolist()

    whole = made()
    for name, value in (("HELD", 2000), ("ROWS", 701), ("TAKEN", 2004)):
        monkeypatch.setattr(histograms, name, value)
    assert isinstance(histograms.room(3000, float), np.memmap)
    for a, b in zip(whole, made(), strict=True):
        np.testing.assert_allclose(a, b)
