"""Forests, bagged trees, AdaBoost and boosted trees on Spark, at their presets' full tree counts.

A fit learns from every labelled row. The edges of its bins are exact quantiles over all of them; the rows are written once as bins, one byte a value,
in the order of their ids' hash. A task reads that table in full into ``Rows`` (files, where they are large); forests grow their trees in
batches, one task each, boosted trees one fold a task, with the fold held out and watched. No row of a fit reaches the driver. Trees come back as
written rows, and every row of the data is scored in its own partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..operators.evaluate import stratified_folds
from ..operators.scaling import Prepared
from ..operators.skew import running_totals
from ..session import cut_lineage
from .histograms import Rule, Trees, ada_boost, binned, blocks, boost, grow, places, room

BATCH = 25  # trees of a task
ENTRIES = 4_000_000  # rows drawn for trees that grow together
EDGED = 128  # columns whose values are counted together
SEED = 1


@dataclass
class Rows:
    """The rows of a fit in a task: bins (a column's lie together), labels and folds (-1 without)."""

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    width: int


@dataclass
class Training:
    """The written rows of a fit (place, y, fold, bins), the first row number of each written part, and the edges that made the bins."""

    table: DataFrame
    starts: np.ndarray
    edges: list[np.ndarray]
    width: int

    def tasks(self, count: int, make: Callable[[int, Rows], object]) -> list:
        """``make(0..count - 1, rows)``, one task each; the results are written, so a lost executor costs its own ones only."""
        starts, width, columns = self.starts, self.width, len(self.edges)

        def run(batches):
            import pyarrow as pa

            k, rows = None, None
            for batch in batches:
                if rows is None:
                    n = int(starts[-1])
                    k, rows = batch.column("k")[0].as_py(), Rows(room((columns, n), np.uint8).T, room(n, float), room(n, np.int32), width)
                place = batch.column("place").to_numpy()
                at = starts[place >> PART_BITS] + (place & (1 << PART_BITS) - 1)
                packed = batch.column("bins").cast(pa.binary())
                ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
                if columns:
                    rows.bins[at] = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, columns)
                rows.y[at], rows.fold[at] = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            if rows is not None:
                yield pa.RecordBatch.from_pydict({"k": [k], "made": [pickle.dumps(make(k, rows))]})

        spark = self.table.sparkSession
        # each task reads the whole table by itself: a product with one number a task, without an exchange
        each = spark.range(0, count, 1, count).withColumnRenamed("id", "k").hint("shuffle_replicate_nl")
        made = cut_lineage(self.table.coalesce(1).crossJoin(each).mapInArrow(run, "k long, made binary"))
        return [pickle.loads(r["made"]) for r in made.orderBy("k").collect()]


PART_BITS = 33  # of monotonically_increasing_id: the number in the partition


def _edges(known: DataFrame, values: list, bins: int) -> list[np.ndarray]:
    """As ``histograms.quantile_edges``, over all rows: distinct values are counted, and those at the wanted places are picked."""
    spark, out = known.sparkSession, [np.empty(0)] * len(values)
    for low in range(0, len(values), EDGED):
        cells = known.select(F.posexplode(F.array(*values[low : low + EDGED])).alias("place", "value"))
        cells = cells.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        counts = cut_lineage(cells.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n")))
        sizes = counts.groupBy("place").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows")).collect()
        few, many = ([r for r in sizes if (r["distinct"] <= bins) == kind] for kind in (True, False))
        found: dict[int, list[float]] = {r["place"]: [] for r in sizes}
        if few:
            named = spark.createDataFrame([(r["place"],) for r in few], "place int")
            for r in counts.join(named, "place").select("place", "value").collect():
                found[r["place"]].append(r["value"])
        if many:
            named = spark.createDataFrame([(r["place"], r["rows"]) for r in many], "place int, rows long")
            upto = running_totals(counts.join(named, "place"), ["place"], [F.col("value").asc()], {"upto": F.col("n")})
            # i * rows div bins, the last row of bin i, is among the rows of this value for some i
            bin_ = F.expr(f"((upto - n + 1) * {bins} + rows - 1) div rows")
            picked = upto.withColumn("i", bin_).filter(f"i < {bins} AND (i * rows) div {bins} <= upto")
            for r in picked.select("place", "value").collect():
                found[r["place"]].append(r["value"])
        for place, own in found.items():
            own = np.unique(own)
            out[low + place] = (own[1:] + own[:-1]) / 2 if any(r["place"] == place for r in few) else own
    return out


def training(rows: DataFrame, features: list[str], id: str, label: str, bins: int = 255, fold: str | None = None) -> Training:
    """All labelled rows, written as bins in the order of their ids' hash."""
    known = rows.filter(F.col(label).isNotNull())
    values = [F.col(f"`{c}`").cast("double") for c in features]
    edges = _edges(known, values, min(bins, 255))
    width, columns = 1 + max((len(e) for e in edges), default=0), len(features)
    shared = known.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            x = np.empty((n, columns))
            for i in range(columns):
                x[:, i] = batch.column(4 + i).to_numpy(zero_copy_only=False)
            ends = pa.py_buffer(np.arange(0, (n + 1) * columns, columns, dtype=np.int32) if columns else np.zeros(n + 1, np.int32))
            packed = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(binned(x, shared.value).tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed], names=["h", "id", "y", "fold", "bins"])

    picks = [F.xxhash64(id).alias("h"), F.col(id).alias("id"), F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold")]
    named = known.select(*picks, *[v.alias(f"x{i}") for i, v in enumerate(values)])
    made = named.mapInArrow(run, f"h long, id {named.schema['id'].dataType.simpleString()}, y double, fold int, bins binary")
    placed = made.orderBy("h", "id", "fold", "y", "bins").select(F.monotonically_increasing_id().alias("place"), "y", "fold", "bins")
    table = cut_lineage(placed)
    sizes = {r["part"]: r["n"] for r in table.groupBy(F.shiftright("place", PART_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        raise ValueError("no labelled rows")
    starts = np.cumsum([0, *[sizes.get(p, 0) for p in range(max(sizes) + 1)]])
    return Training(table, starts, edges, width)


def _drawn(rng: np.random.Generator, rows: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, times) of ``count`` rows drawn with replacement, in order."""
    times = room(rows, np.int32)
    for a, b in blocks(count):
        np.add.at(times, rng.integers(0, rows, b - a), 1)
    at = places(rows, lambda a, b: times[a:b] > 0)
    # times that a row was drawn are small whole numbers, which single precision holds exactly
    found = room(len(at), np.float32)
    for a, b in blocks(len(at)):
        found[a:b] = times[at[a:b]]
    return at, found


def _forest(data: Training, rule: Rule, trees: int, rows: int | None = None) -> Trees:
    """Trees on rows drawn with replacement: as many as there are, or ``rows``."""

    def together(s: Rows, n: int, rng: np.random.Generator) -> Trees:
        drawn = [_drawn(rng, len(s.y), rows or len(s.y)) for _ in range(n)]
        size = sum(len(at) for at, _ in drawn)
        row, tree, count, ones = room(size, drawn[0][0].dtype), room(size, np.int32), room(size, np.float32), room(size, np.float32)
        end = 0
        for k, (at, times) in enumerate(drawn):
            for a, b in blocks(len(at)):
                here = slice(end + a, end + b)
                row[here], tree[here], count[here] = at[a:b], k, times[a:b]
                ones[here] = times[a:b] * s.y[at[a:b]].astype(np.float32)
            end += len(at)
        del drawn
        return grow(s.bins, row, tree, ones, count, count, n, rule, rng, s.width)

    def batch(k: int, s: Rows) -> Trees:
        rng, n = np.random.default_rng([SEED, k]), min(BATCH, trees - k * BATCH)
        step = max(1, min(BATCH, ENTRIES // max(1, len(s.y))))
        return Trees.joined([together(s, min(step, n - at), rng) for at in range(0, n, step)])

    return Trees.joined(data.tasks(-(-trees // BATCH), batch))


def scored(rows: DataFrame, features: list[str], edges: list[np.ndarray], columns: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """``rows`` with further columns, each a function of the row's bins; nothing is exchanged."""
    return _scored_by(rows, features, [(edges, columns)])


def _scored_by(rows: DataFrame, features: list[str], models: list[tuple[list[np.ndarray], dict[str, Callable[[np.ndarray], np.ndarray]]]]) -> DataFrame:
    """As ``scored`` for models with edges of their own, all in one pass and one Python process a task."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps([(edges, list(columns.values())) for edges, columns in models]))
    names = [n for _, columns in models for n in columns]
    kept = [c for c in rows.columns if c not in names]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept], *[f"`{n}` double" for n in names]])

    def run(batches):
        import pyarrow as pa

        own = pickle.loads(shared.value)
        width = len(features)
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(len(kept) + i).to_numpy(zero_copy_only=False), float) for i in range(width)]) if width else np.zeros((batch.num_rows, 0))
            made = []
            for edges, makes in own:
                bins = binned(x, edges)
                made += [pa.array(make(bins), pa.float64()) for make in makes]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *names])

    values = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *values).mapInArrow(run, fields)


# The presets' tree counts, depths, shares, sample sizes and split rules.
FOREST = (Rule(depth=8, criterion="entropy", node_share=0.5), 1000, None)
BAGGED = (Rule(depth=6, criterion="gini", tree_share=0.3), 1000, 1000)
TREE = Rule(depth=30, criterion="entropy", min_split=100, node_share=0.8)
ADA = (Rule(depth=6, criterion="gini"), 500)

PATIENCE = 200
# Rule, rounds, step, share of rows, bins, whether a held-out fold ends the rounds.
BOOSTING = {
    "lightgbm": (Rule(depth=5, l1=3, l2=3, min_gain=0.0000215, min_leaf=20, min_weight=0.001, tree_share=0.8), 10_000, 0.01, 0.7, 25, True),
    "litegbm": (Rule(depth=5, l1=3, l2=3, min_gain=0.0000215, min_leaf=20, min_weight=0.001, tree_share=0.8), 10_000, 1.0, 0.7, 25, True),
    "xgboost": (Rule(depth=7, l1=0.25, l2=80, min_weight=35, tree_share=0.632), 100, 0.02, 0.8, 255, True),
    "catboost": (Rule(depth=7, l2=3), 2800, 0.01, 1.0, 254, False),
    "gradient_boosting": (Rule(depth=7, min_split=15), 1000, 0.01, 1.0, 255, False),
}


BINS = 64  # of the columns of forests and of AdaBoost


def _learned(data: Prepared, fit: Callable[[Training], Callable[[np.ndarray], np.ndarray]], name: str) -> DataFrame:
    found = training(data.frame, data.features, data.id, data.label, BINS)
    rows = data.frame.select(data.id, *[F.col(f"`{c}`") for c in data.features])
    return scored(rows, data.features, found.edges, {name: fit(found)}).select(data.id, name)


def random_forest(data: Prepared, name: str = "random_forest", trees: int = FOREST[1]) -> DataFrame:
    """Entropy trees of depth 8 on bootstrap samples, half of the columns at each node."""
    return _learned(data, lambda found: _forest(found, FOREST[0], trees).mean, name)


def bagged_trees(data: Prepared, name: str = "bagging_classifier", trees: int = BAGGED[1]) -> DataFrame:
    """Trees of depth 6, each on 1,000 drawn rows and its own 0.3 of the columns."""
    return _learned(data, lambda found: _forest(found, BAGGED[0], trees, BAGGED[2]).mean, name)


def decision_tree(data: Prepared, name: str = "decision_tree_classifier", rule: Rule = TREE) -> DataFrame:
    """One entropy tree; nodes below 100 rows aren't split, and each node chooses from 0.8 of the columns."""

    def one(_: int, s: Rows) -> Trees:
        return grow(s.bins, None, None, s.y, None, None, 1, rule, np.random.default_rng(SEED), s.width)

    return _learned(data, lambda found: found.tasks(1, one)[0].mean, name)


def ada_boosted(data: Prepared, name: str = "adaboost_classifier", rounds: int = ADA[1], rule: Rule = ADA[0]) -> DataFrame:
    """AdaBoost (SAMME.R) over trees of depth 6; weights and sums stay apart from the rows."""

    def fit(found: Training):
        trees = found.tasks(1, lambda _, s: ada_boost(s.bins, s.y, rule, np.random.default_rng(SEED), s.width, rounds))[0]
        return lambda bins: 1 / (1 + np.exp(-trees.mean(bins)))

    return _learned(data, fit, name)


@dataclass
class Boosted:
    """Rows (id, label, fold, held_out, average), and of each fold the number of trees kept and the AUC by round."""

    scores: DataFrame
    kept: list[int]
    history: list[list[float]]


def boosted_trees(data: Prepared, preset: str, folds: int = 5, patience: int = PATIENCE, **changes) -> Boosted:
    """Boosted trees of one preset, a model for each fold; scores are those of each model's best round on the fold held out.

    ``held_out`` is the score of the model that did not see a row (null without a label), ``average`` the mean of all models.
    """
    rule, rounds, step, share, bins, watched = BOOSTING[preset]
    rounds, rule = changes.pop("rounds", rounds), replace(rule, **changes)
    parts = cut_lineage(stratified_folds(data.labelled, data.id, data.label, folds))
    found = training(parts, data.features, data.id, data.label, bins, "fold")

    def one(k: int, s: Rows):
        held = room(len(s.y), bool)
        for a, b in blocks(len(held)):
            held[a:b] = s.fold[a:b] == k
        return boost(s.bins, s.y, held, rule, np.random.default_rng([SEED, k]), s.width, rounds, step, share, patience if watched else None)

    models = found.tasks(folds, one)

    def scorer(trees: Trees, base: float):
        return lambda bins: 1 / (1 + np.exp(-(base + trees.total(bins))))

    columns = {f"_score{k}": scorer(trees, base) for k, (trees, base, _) in enumerate(models)}
    unlabelled = data.frame.filter(F.col(data.label).isNull()).withColumn("fold", F.lit(None).cast("int"))
    rows = scored(parts.unionByName(unlabelled), data.features, found.edges, columns)
    every = F.array(*columns)
    average = F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / folds
    out = rows.select(data.id, data.label, "fold", F.get(every, F.col("fold")).alias("held_out"), average.alias("average"))
    return Boosted(out, [len(t.roots) for t, _, _ in models], [h for _, _, h in models])


@dataclass
class ForestScorer:
    """Rows with a forest's score column; ``together`` scores them by several forests in one pass."""

    features: list[str]
    edges: list[np.ndarray]
    forest: Trees

    def __call__(self, rows: DataFrame, name: str) -> DataFrame:
        return self.together([self], rows, [name])

    @staticmethod
    def together(scorers: list[ForestScorer], rows: DataFrame, names: list[str]) -> DataFrame:
        return _scored_by(rows, scorers[0].features, [(s.edges, {n: s.forest.mean}) for s, n in zip(scorers, names, strict=True)])


def forest_learner(features: list[str], id: str = "SK_ID_CURR", label: str = "TARGET", trees: int = FOREST[1]) -> Callable:
    """The ``learn`` argument of ``stack.cross_fit``."""

    def learn(labelled: DataFrame):
        found = training(labelled, features, id, label, BINS)
        forest = _forest(found, FOREST[0], trees)
        return ForestScorer(features, found.edges, forest)

    return learn


def forest_importances(labelled: DataFrame, features: list[str], id: str = "SK_ID_CURR", label: str = "TARGET", trees: int = FOREST[1]) -> DataFrame:
    """(feature, importance): the share of all gain that a column brought; as many rows as columns."""
    found = training(labelled, features, id, label, BINS)
    gain = _forest(found, FOREST[0], trees).importance(len(features))
    gain = gain / (gain.sum() or 1.0)
    return labelled.sparkSession.createDataFrame(list(zip(features, map(float, gain), strict=True)), "feature string, importance double")
