"""Properties of folds, learners, neighbours and blends."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.models import components, discriminant, ensembles, histograms, learners, neighbors, perceptron, stack
from scoreloom.operators.evaluate import stratified_folds
from scoreloom.operators.scaling import Prepared, prepare


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1.0, 3.0, 0.5]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=300) > 0).astype(float)
    pdf = pd.DataFrame({"SK_ID_CURR": range(300), "TARGET": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    frame = spark.createDataFrame(pdf).withColumn("TARGET", F.when(F.col("SK_ID_CURR") % 6 > 0, F.col("TARGET")))
    return pdf, Prepared(frame.persist(), ["a", "b", "c"])


def test_folds_are_balanced(spark):
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    counts = stratified_folds(df, "id", "y").groupBy("y", "fold").count().toPandas()
    spread = counts.groupby("y")["count"].agg(lambda s: s.max() - s.min())
    assert len(counts) == 10 and (spread <= 1).all()


def test_cross_fit_has_no_leak(data):
    _, prepared = data
    seen = []

    def learn(rows):
        ids = {r["SK_ID_CURR"] for r in rows.select("SK_ID_CURR").collect()}
        seen.append(ids)
        mine = F.col("SK_ID_CURR").isin(list(ids)).cast("double")
        return lambda r, name: r.withColumn(name, mine)

    labelled = prepared.labelled
    unlabelled = prepared.frame.filter("TARGET IS NULL").drop("TARGET")
    out = stack.cross_fit(labelled, unlabelled, learn).toPandas()
    assert len(out) == 300 and len(seen) == 5
    known = out[out["fold"].notna()]
    assert (known["held_out"] == 0).all() and known["average"].round(9).eq(0.8).all()
    assert (out[out["fold"].isna()]["average"] == 0).all()


@pytest.mark.parametrize(
    "score",
    [
        learners.logistic_regression,
        learners.sgd_logistic,
        learners.linear_svm,
        learners.gaussian_mixture,
        ensembles.ada_boosted,
        ensembles.decision_tree,
        ensembles.random_forest,
        ensembles.bagged_trees,
        lambda d, name: ensembles.boosted_trees(d, "xgboost").scores.withColumnRenamed("average", name),
        lambda d, name: perceptron.perceptron(d, name, hidden=(4,), steps=20),
        lambda d, name: discriminant.linear_discriminant(d, name=name),
        lambda d, name: discriminant.quadratic_discriminant(d, name=name),
    ],
)
def test_scores_are_probabilities(data, score):
    pdf, prepared = data
    out = score(prepared, name="p").toPandas().set_index("SK_ID_CURR")["p"].sort_index()
    assert len(out) == 300 and out.between(0, 1).all()


def plain_tree(bins, rows, g, h, rule, depth=0):
    """A tree by trying every split of every node; ``(value,)`` or ``(column, bin, left, right)``."""
    def worth(r):
        pull = max(abs(g[r].sum()) - rule.l1, 0)
        return pull * pull / (h[r].sum() + rule.l2) / 2

    best = (max(rule.min_gain, 1e-12), None)
    if depth < rule.depth and len(rows) >= rule.min_split:
        for k in range(bins.shape[1]):
            for b in np.unique(bins[rows, k])[:-1]:
                low, high = rows[bins[rows, k] <= b], rows[bins[rows, k] > b]
                if min(len(low), len(high)) >= rule.min_leaf and min(h[low].sum(), h[high].sum()) >= rule.min_weight:
                    gain = worth(low) + worth(high) - worth(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (k, b, low, high))
    if best[1] is None:
        total = g[rows].sum()
        return (-np.sign(total) * max(abs(total) - rule.l1, 0) / (h[rows].sum() + rule.l2),)
    k, b, low, high = best[1]
    return k, b, plain_tree(bins, low, g, h, rule, depth + 1), plain_tree(bins, high, g, h, rule, depth + 1)


def plain_value(tree, row):
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def learning_rows(n=1000):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.5 > 0).astype(float)
    edges = histograms.quantile_edges(x, 16)
    return histograms.binned(x, edges), y, 16


def test_boosting_equals_a_plain_booster():
    bins, y, width = learning_rows()
    rule = histograms.Rule(depth=3, l1=0.1, l2=1.0, min_leaf=10, min_weight=1.0)
    held = np.arange(1000) % 5 == 0
    trees, base, history = histograms.boost(bins, y, held, rule, np.random.default_rng(0), width, 8, 0.3, patience=8)
    fit, score = np.flatnonzero(~held), np.full(1000, np.log(y[~held].mean() / (1 - y[~held].mean())))
    assert base == pytest.approx(score[0])
    want = []
    for _ in range(8):
        p = 1 / (1 + np.exp(-score))
        tree = plain_tree(bins, fit, p - y, p * (1 - p), rule)
        score = score + 0.3 * np.array([plain_value(tree, row) for row in bins])
        want.append((histograms.auc(score[held], y[held]), score))
    assert np.allclose(history, [a for a, _ in want])
    best = int(np.argmax(history))
    assert len(trees.roots) == best + 1
    np.testing.assert_allclose(base + trees.total(bins), want[best][1], atol=1e-9)


def test_rounds_end_after_the_best():
    bins, y, width = learning_rows()
    noise = np.random.default_rng(1).permutation(y)
    trees, _, history = histograms.boost(bins, noise, np.arange(1000) % 5 == 0, histograms.Rule(depth=4), np.random.default_rng(0), width, 10_000, 0.3, patience=20)
    assert len(history) == len(trees.roots) + 20 < 200 and max(history) == history[len(trees.roots) - 1]


def test_levels_in_pieces_give_the_same_trees(monkeypatch):
    bins, y, width = learning_rows()
    rule = histograms.Rule(depth=6, criterion="entropy", min_split=30, node_share=0.6)
    n, one = len(y), np.ones(len(y))

    def tree():
        row, which = np.tile(np.arange(n), 3), np.repeat(np.arange(3), n)
        return histograms.grow(bins, row, which, y[row], one[row], one[row], 3, rule, np.random.default_rng(4), width)

    whole = tree()
    monkeypatch.setattr(histograms, "CELLS", 5 * width * 2)
    monkeypatch.setattr(histograms, "ENTRIES", 700)
    pieces = tree()
    for name in ("feature", "cut", "left"):
        assert getattr(whole, name).tolist() == getattr(pieces, name).tolist()
    np.testing.assert_allclose(whole.value, pieces.value)
    inner = whole.left != np.arange(len(whole.left))
    assert inner.sum() > 20 and (whole.gain[inner] > 0).all()


def test_auc_counts_ties_half():
    score, label = np.array([0.1, 0.4, 0.4, 0.8, 0.4]), np.array([0, 1, 0, 1, 0])
    wins = sum((a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0])
    assert histograms.auc(score, label) == pytest.approx(wins / 6) and histograms.auc(score, label * 0) == 0.5


def test_ensembles_at_full_size_learn(data):
    pdf, prepared = data
    known = pdf.SK_ID_CURR % 6 > 0
    boosted = ensembles.boosted_trees(prepared, "litegbm", l1=0.0, l2=1.0)
    rows = boosted.scores.toPandas().set_index("SK_ID_CURR").sort_index()
    assert rows["fold"].isna().sum() == 50 and rows["held_out"].isna().sum() == 50 and len(boosted.kept) == 5
    assert all(len(h) == kept + ensembles.PATIENCE for h, kept in zip(boosted.history, boosted.kept, strict=True))
    labels = rows[known.to_numpy()]
    for fold, history, kept in zip(range(5), boosted.history, boosted.kept, strict=True):
        own = labels[labels.fold == fold]
        assert histograms.auc(own["held_out"].to_numpy(), own["TARGET"].to_numpy()) == pytest.approx(history[kept - 1])
    for learn in (ensembles.random_forest, ensembles.bagged_trees, ensembles.ada_boosted):
        score = learn(prepared, "p").toPandas().set_index("SK_ID_CURR").sort_index()["p"].to_numpy()
        assert histograms.auc(score[~known.to_numpy()], pdf.TARGET[~known].to_numpy()) > 0.65
    shares = ensembles.forest_importances(prepared.labelled, prepared.features, trees=60).toPandas()
    assert shares.importance.sum() == pytest.approx(1) and shares.importance.idxmax() in (0, 1)


def test_gradient_of_the_perceptron():
    rng = np.random.default_rng(2)
    network, x, y = perceptron.Network(4, (6, 3)), rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float)
    flat = network.start()
    _, gradient = network.loss(flat, x, y)
    for k in rng.choice(network.size, 25, replace=False):
        step = np.zeros(network.size)
        step[k] = 1e-6
        slope = (network.loss(flat + step, x, y)[0] - network.loss(flat - step, x, y)[0]) / 2e-6
        assert gradient[k] == pytest.approx(slope, abs=1e-5)
    assert network.weights().sum() == 4 * 6 + 6 * 3 + 3


def test_lbfgs_finds_minima():
    def bowl(x):
        return (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    point, _, steps = perceptron.lbfgs(np.array([-1.2, 1.0]), bowl)
    np.testing.assert_allclose(point, [1, 1], atol=1e-3)
    assert steps < 100


def test_perceptron_learns_and_is_pulled_to_zero(data, monkeypatch):
    pdf, prepared = data
    known = (pdf.SK_ID_CURR % 6 > 0).to_numpy()
    free = perceptron.perceptron(prepared, "p", hidden=(8, 4), alpha=0.1, steps=60).toPandas().set_index("SK_ID_CURR").sort_index()["p"].to_numpy()
    assert histograms.auc(free[known], pdf.TARGET[known].to_numpy()) > 0.8
    monkeypatch.setattr(perceptron, "TASK_ROWS", 60)
    network, flat, _ = perceptron.fitted(prepared, hidden=(8, 4), steps=25)
    assert np.abs(flat[network.weights()]).max() < 0.05  # at alpha 80 little is left of the weights of 250 rows


def test_sigmoid_has_the_least_loss(spark):
    rng = np.random.default_rng(6)
    f = rng.normal(size=400) * 2
    y = (f + rng.normal(size=400) * 2 > 0.5).astype(float)
    a, b = learners.sigmoid(spark.createDataFrame(pd.DataFrame({"f": f, "y": y})), "f", "y")
    p, n = int(y.sum()), int((1 - y).sum())
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))

    def loss(a, b):
        q = 1 / (1 + np.exp(a * f + b))
        return -(t * np.log(q) + (1 - t) * np.log(1 - q)).sum()

    best = loss(a, b)
    assert a < 0 and all(loss(a + da, b + db) > best for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (1e-3, 1e-3), (-1e-3, 1e-3)))


def test_mergeable_aggregates(spark):
    """A third of all rows share a key, and some have none."""
    from scoreloom.functions import user

    rows = [(1 if i % 3 == 0 else None if i % 50 == 1 else i % 40, float(i)) for i in range(6000)]
    frame = spark.createDataFrame(rows, "k long, v double").repartition(5)
    out = user.grouped_aggregate(
        frame, "k", lambda: (0, 0.0), lambda s, r: (s[0] + len(r), s[1] + r["v"].sum()), lambda a, b: (a[0] + b[0], a[1] + b[1]),
        lambda s: {"n": s[0], "total": s[1]}, "n bigint, total double",
    )
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k", dropna=False)["v"].agg(["size", "sum"])
    got = {r["k"]: (r["n"], r["total"]) for r in out.collect()}
    assert got == {None if pd.isna(k) else int(k): (r["size"], r["sum"]) for k, r in want.iterrows()}
    text = user.grouped_aggregate(frame.selectExpr("CAST(k AS STRING) AS k", "v"), "k", lambda: 0, lambda s, r: s + len(r), lambda a, b: a + b, lambda s: {"n": s}, "n bigint")
    assert {r["k"]: r["n"] for r in text.collect()} == {None if k is None else str(k): n for k, (n, _) in got.items()}


def test_held_out_discriminants_match_numpy(data):
    pdf, prepared = data
    folded = prepared.frame.withColumn("fold", F.when(F.col("TARGET").isNotNull(), F.col("SK_ID_CURR") % 4))
    train = pdf[pdf.SK_ID_CURR % 6 > 0]
    for form in ("linear", "quadratic"):
        got = discriminant.held_out(Prepared(folded, prepared.features), "fold", form, "p").toPandas().set_index("SK_ID_CURR")["p"]
        for fold in range(4):
            rest = train[train.SK_ID_CURR % 4 != fold]
            frame = folded.filter(F.col("SK_ID_CURR").isin(rest.SK_ID_CURR.tolist()) | (F.col("SK_ID_CURR") % 4 == fold))
            frame = frame.withColumn("TARGET", F.when(F.col("SK_ID_CURR") % 4 != fold, F.col("TARGET")))
            plain = discriminant.linear_discriminant if form == "linear" else discriminant.quadratic_discriminant
            want = plain(Prepared(frame, prepared.features), name="p").toPandas().set_index("SK_ID_CURR")["p"]
            own = train[train.SK_ID_CURR % 4 == fold].SK_ID_CURR
            np.testing.assert_allclose(got[own], want[own], rtol=1e-8)


def test_discriminants_match_numpy(data):
    pdf, prepared = data
    train = pdf[pdf.SK_ID_CURR % 6 > 0]
    x, y, every = train[list("abc")].to_numpy(), train["TARGET"].to_numpy(), pdf[list("abc")].to_numpy()
    means = [x[y == c].mean(axis=0) for c in (0, 1)]
    covs = [np.cov(x[y == c].T) for c in (0, 1)]
    n = [int((y == c).sum()) for c in (0, 1)]
    pooled = sum((n[c] - 1) * covs[c] for c in (0, 1)) / (sum(n) - 2)

    def posterior(cov):
        logs = []
        for c in (0, 1):
            away = every - means[c]
            quad = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov[c]), away)
            logs.append(np.log(n[c]) - 0.5 * np.linalg.slogdet(cov[c])[1] - 0.5 * quad)
        return 1 / (1 + np.exp(logs[0] - logs[1]))

    for frame, cov in (
        (discriminant.linear_discriminant(prepared, name="p"), [pooled, pooled]),
        (discriminant.quadratic_discriminant(prepared, name="p"), covs),
    ):
        got = frame.toPandas().set_index("SK_ID_CURR").sort_index()["p"].to_numpy()
        np.testing.assert_allclose(got, posterior(cov), rtol=1e-8)


def test_components(data):
    pdf, prepared = data
    parts = components.principal_components(prepared, 3)
    assert parts.explained == sorted(parts.explained, reverse=True) and sum(parts.explained) == pytest.approx(1.0)
    train = pdf[pdf.SK_ID_CURR % 6 > 0][list("abc")].to_numpy()
    _, _, axes = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)
    want = np.abs((pdf[list("abc")].to_numpy() - train.mean(axis=0)) @ axes.T)
    got = parts.scores.toPandas().set_index("SK_ID_CURR").sort_index().abs().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-8)
    with pytest.raises(ValueError):
        components.principal_components(prepared, 2, kernel="rbf")


def points(spark, n, seed, d=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.choice([0.2, 5.0], size=(n, 1))
    x[: n // 3] = x[0]  # a third of all points in one place
    pdf = pd.DataFrame({"id": np.arange(n), "y": rng.integers(0, 2, n), "v": list(x)})
    return pdf, spark.createDataFrame(pdf[["id", "y"]].assign(v=[r.tolist() for r in x]))


@pytest.mark.parametrize("k", [1, 7, 500])
def test_nearest_is_exact(spark, monkeypatch, k):
    for name, value in {"LEAF_ROWS": 10, "BLOCK_ROWS": 25, "CHUNK_ROWS": 60}.items():
        monkeypatch.setattr(neighbors, name, value)
    qp, q = points(spark, 90, 1)
    tp, t = points(spark, 200, 2)
    out = neighbors.nearest(q, t, k, "id", "v", ["y"]).toPandas().sort_values(["id", "rn"])
    a, b = np.stack(qp.v), np.stack(tp.v)
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    for i in range(len(qp)):
        order = np.lexsort((tp.id.to_numpy(), d[i]))[:k]
        mine = out[out.id == i]
        assert mine.neighbor.tolist() == tp.id.to_numpy()[order].tolist()
        assert mine.y.tolist() == tp.y.to_numpy()[order].tolist()


def test_nearest_measures_few_pairs(spark, monkeypatch):
    """40 clusters in 20 dimensions, and a third of all points in one place."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 20)) * 10
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 20))
    x = np.concatenate([x, np.tile(centres[0], (2000, 1))])
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(6000), "v": x.tolist()}))
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 50)
    measured, plain = [], neighbors._measured

    def counting(visits, held, k, carry):
        asked = visits.groupBy("_leaf", "_block").agg(F.count(F.lit(1)).alias("a"))
        there = held.groupBy("_leaf", "_block").agg(F.count(F.lit(1)).alias("b"))
        measured.append(asked.join(there, ["_leaf", "_block"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)
        return plain(visits, held, k, carry)

    monkeypatch.setattr(neighbors, "_measured", counting)
    out = neighbors.nearest(frame, frame, 5, "id", "v").toPandas()
    assert len(out) == 30_000 and sum(measured) < 6000 * 6000 / 5
    near = out[out.id == 5999].sort_values("rn").neighbor.tolist()
    assert near == list(range(4000, 4005))
    for i in (0, 17, 3999):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert out[out.id == i].sort_values("rn").neighbor.tolist() == np.lexsort((np.arange(6000), d))[:5].tolist()


def test_descent_finds_most_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    exact = neighbors.neighbor_graph(rows, "vec_id", "embedding")
    near = neighbors.descent_graph(rows, "vec_id", "embedding", 7, leaf_rows=32)
    assert near.groupBy("vec_id").count().agg(F.min("count"), F.max("count")).first() == (7, 7)
    assert near.join(exact, ["vec_id", "neighbor"]).count() >= 0.9 * exact.count()


def test_shares_at_full_size_are_the_base_rate(spark):
    tp, t = points(spark, 60, 4)
    out = neighbors.neighbor_shares(t, t, "id", "v", "y", [60]).toPandas()
    assert out["knn_60_neighbors"].round(12).nunique() == 1
    assert out["knn_60_neighbors"][0] == pytest.approx(tp.y.mean())


def test_propagation_ends_when_nothing_moves(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 2)], "id int, neighbor int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, None)], "id int, y int")
    moves, plain = [], neighbors._moved
    monkeypatch.setattr(neighbors, "_moved", lambda *a: moves.append(1) or plain(*a))
    out = {r["id"]: r["p"] for r in neighbors.label_propagation(edges, labels, "id", "y", 500, 2, name="p").collect()}
    assert out == {1: 1.0, 2: 1.0, 3: 1.0} and len(moves) < 500


def test_propagation_keeps_labels_and_reaches_the_rest(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 2)], "id int, neighbor int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, None)], "id int, y int")
    out = {r["id"]: r["p"] for r in neighbors.label_propagation(edges, labels, "id", "y", 6, 2, name="p").collect()}
    assert out == {1: 1.0, 2: 1.0, 3: 1.0}


def test_blend_of_equal_inputs_is_identity(spark):
    a = spark.createDataFrame([(1, 0.2), (2, 0.8)], "SK_ID_CURR int, a double")
    out = stack.blend({"a": a, "b": a.withColumnRenamed("a", "b")}, {"a": 0.5, "b": 0.5}).collect()
    assert {r["SK_ID_CURR"]: r["TARGET"] for r in out} == {1: pytest.approx(0.2), 2: pytest.approx(0.8)}


def test_discriminants_at_full_width(spark):
    """544 columns, as wide as the models' input; compared with numpy."""
    rng = np.random.default_rng(5)
    n, d = 1500, 544
    y = (np.arange(n) % 2).astype(float)
    x = rng.normal(size=(n, d)) + 0.05 * y[:, None]
    names = [f"c{i}" for i in range(d)]
    rows = pd.DataFrame(x, columns=names).assign(SK_ID_CURR=np.arange(n), TARGET=y)
    data = Prepared(spark.createDataFrame(rows), names)
    linear = discriminant.linear_discriminant(data, "lsqr", "s").toPandas().sort_values("SK_ID_CURR")["s"].to_numpy()
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    pooled = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in ((0, m0), (1, m1))) / n
    odds = (x - (m0 + m1) / 2) @ np.linalg.solve(pooled, m1 - m0)
    assert np.allclose(linear, 1 / (1 + np.exp(-odds)), atol=1e-6)
    quadratic = discriminant.quadratic_discriminant(data, "s").toPandas().sort_values("SK_ID_CURR")["s"].to_numpy()
    assert ((quadratic > 0.5) == (y > 0)).mean() > 0.95


def test_grouped_map_streams_its_groups(spark):
    from scoreloom.functions.user import grouped_map

    rows = [(k, float(i)) for i in range(50) for k in ("a", None)] + [("b", 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    out = grouped_map(frame, "k", lambda frames: {"n": sum(len(f) for f in frames)}, "n bigint").collect()
    assert {r["k"]: r["n"] for r in out} == {"a": 50, None: 50, "b": 1}
    first = grouped_map(frame, "k", lambda frames: {"n": len(next(frames))}, "n bigint")
    assert first.count() == 3


def test_log_drops_columns_at_minus_one(spark):
    frame = spark.createDataFrame([(1, 1, 2.0, None), (2, 0, 4.0, "x"), (3, None, 9.0, "y")], "SK_ID_CURR long, TARGET int, x double, s string")
    assert prepare(frame, "norm", log=True).features == ["x"]
    assert sorted(prepare(frame, "norm", log=False).features) == ["s", "x"]


def test_bind_keeps_every_id(spark):
    left, right = spark.createDataFrame([(1, 0.1), (2, 0.2)], "SK_ID_CURR long, a double"), spark.createDataFrame([(2, 0.5)], "SK_ID_CURR long, b double")
    assert sorted(stack.stacking_table([left, right]).collect()) == [(1, 0.1, None), (2, 0.2, 0.5)]


def test_queries_are_exchanged_once(spark, monkeypatch):
    """Points without structure: a row for each query and group of points, none for each visit to a leaf."""
    x = np.random.default_rng(8).normal(size=(2000, 16))
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "v": x.tolist()}))
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 20)
    asked, plain = [], neighbors._measured

    def counting(visits, held, k, carry):
        asked.append((visits.count(), held.count()))
        return plain(visits, held, k, carry)

    monkeypatch.setattr(neighbors, "_measured", counting)
    out = neighbors.nearest(frame, frame, 30, "id", "v").toPandas()
    assert len(out) == 60_000 and [n for n, _ in asked] == [2000] and asked[0][1] <= 2000 * 12
    for i in (0, 999):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert out[out.id == i].sort_values("rn").neighbor.tolist() == np.lexsort((np.arange(2000), d))[:30].tolist()


def test_many_points_at_one_distance(spark, monkeypatch):
    """More ties than are wanted, an id with two rows, and points in pieces: the smallest ids, as one sort over all pairs gives."""
    x = np.concatenate([np.eye(40), -np.eye(40), np.zeros((1, 40))])
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(81), "v": x.tolist()}))
    twice = frame.filter("id = 80").unionByName(frame.filter("id = 80"))
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 5)
    assert neighbors.nearest(frame.filter("id = 80"), frame, 6, "id", "v").toPandas().sort_values("rn").neighbor.tolist() == [80, 0, 1, 2, 3, 4]
    assert neighbors.nearest(twice, frame, 6, "id", "v").toPandas().sort_values("rn").neighbor.tolist() == [80, 80, 0, 0, 1, 1]
    near = neighbors.Nearest(np.zeros((3, 4)), np.full(3, 2.0), 5)
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(900, 4)) / 2, 1)
    for at in range(0, 900, 50):
        near.add(points[at : at + 50], at)
        near.cut()
    _, _, point = near.cut(np.arange(900))
    d = np.sqrt((points**2).sum(axis=1))
    assert point.tolist() == 3 * np.lexsort((np.arange(900), d))[:5].tolist()


@pytest.mark.parametrize("spread", [neighbors.label_propagation, neighbors.label_spreading])
def test_edges_are_computed_once(spark, spread):
    """The graph is the costly part: both readings of it (degrees, weights) go to the written table."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame([(i, (i + j) % 20) for i in range(20) for j in range(3)], "id long, neighbor long").mapInPandas(counted, "id long, neighbor long")
    labels = spark.range(20).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 2 AS INT) END AS y")
    assert spread(edges, labels, "id", "y", rounds=5).count() == 20
    assert seen.value == 60


def test_folds_are_scored_in_one_python_step(spark, data):
    """One Arrow map, so one Python process a task, whatever the number of folds; the scores are those of each forest alone."""
    prepared = data[1]
    made = []

    def learn(labelled):
        made.append(ensembles.forest_learner(prepared.features, trees=20)(labelled))
        return made[-1]

    labelled = prepared.labelled
    out = stack.cross_fit(labelled, prepared.frame.filter(F.col("TARGET").isNull()), learn)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2 and len(made) == 5
    whole = out.toPandas().set_index("SK_ID_CURR")
    alone = pd.concat([m(labelled, "s").toPandas().set_index("SK_ID_CURR")["s"].rename(i) for i, m in enumerate(made)], axis=1)
    for i, row in whole[whole.fold.notna()].iterrows():
        assert row.held_out == pytest.approx(alone.loc[i, int(row.fold)]) and row.average == pytest.approx(alone.loc[i].mean())


def test_histograms_hold_little_beside_the_rows():
    """Columns are summed one at a time: no value of a row is repeated for each of its columns."""
    import tracemalloc

    rng = np.random.default_rng(0)
    x, node = rng.integers(0, 20, (30, 60_000)).astype(np.uint8), rng.integers(0, 4, 60_000)
    g, one = rng.normal(size=60_000), np.ones(60_000)
    tracemalloc.start()
    found = histograms._sums(x, node, 4, 20, (g, one, one))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000
    for n, c, b in ((0, 0, 0), (3, 29, 19), (2, 11, 7)):
        mine = (node == n) & (x[c] == b)
        assert found[:, n, c, b] == pytest.approx([g[mine].sum(), mine.sum(), mine.sum()])


def test_descent_groups_cross_batches(spark, monkeypatch):
    """Small batches cut groups apart; ids may be texts. No function is called for each group of a round."""
    x = np.random.default_rng(5).normal(size=(300, 6))
    frame = spark.createDataFrame(pd.DataFrame({"id": [f"p{i:03d}" for i in range(300)], "v": x.tolist()}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    written, plain = [], neighbors.cut_lineage

    def counting(df):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(neighbors, "cut_lineage", counting)
    try:
        near = neighbors.descent_graph(frame, "id", "v", 5, leaf_rows=32).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(f"p{i:03d}", f"p{j:03d}") for i in range(300) for j in np.argsort(d[i])[:5]}
    assert len(near) == 1500 and len(want & set(zip(near.id, near.neighbor))) >= 0.95 * len(want)
    assert "FlatMapGroupsInPandas" not in written[-1] and "MapInArrow" in written[-1]
