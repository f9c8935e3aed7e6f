"""Exact nearest neighbours, a neighbour graph by descent, and label propagation over the graph.

``nearest`` routes all points through a metric tree (``metric_tree``), whose balls give every query a radius that surely holds k points. Queries of
neighbouring leaves form a group, which gets the points of every leaf whose ball reaches into the radius of one of its queries. No leaf that
may hold a neighbour is left out, so the result is exact. A group's points pass its task batch by batch while each query keeps its nearest so far, so
only points are exchanged, once for each group, and neither visits nor distances are. The number of groups follows the cores, until a group holds
``CHUNK_ROWS`` queries or ``HELD`` neighbours. What the tasks hold is the tree, whose number of leaves is bounded, a group's queries and their nearest points. Of points
in one place only the k smallest ids can be neighbours, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from . import metric_tree

LEAF_ROWS = 512  # wanted points of a leaf
MAX_LEAVES = 16_384  # the tree held by every task; leaves grow beyond LEAF_ROWS * MAX_LEAVES points
BLOCK_ROWS = 256  # fewest queries of a group, as long as there are so many
CHUNK_ROWS = 32_768  # most queries of a group
HELD = 8_000_000  # most neighbours that a group's task keeps
SEEN = 8192  # most points of the tree's choice that every query is measured against first
WAVES = 4  # wanted groups for each core
TREES = 4  # of the start of a descent
SLACK = 1e-6  # rounding room in the bounds, a share of the vectors' length; never excludes a neighbour


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _vectors(column) -> np.ndarray:
    """The rows of an Arrow list column of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def grown_tree(points: DataFrame, count: int) -> tuple[metric_tree.Tree, np.ndarray]:
    """A tree over points ``_t, _v`` from a fixed pseudo-random choice of them, bounded by ``MAX_LEAVES``, and some of the chosen ones."""
    leaves = max(1, min(MAX_LEAVES, math.ceil(count / LEAF_ROWS)))
    rows = points.orderBy(F.xxhash64("_t"), "_t").limit(leaves * metric_tree.SAMPLE_ROWS).select("_v").collect()
    chosen = np.array([r["_v"] for r in rows], dtype=float)
    return metric_tree.build(chosen, leaves), chosen[:SEEN]


def _routed(points: DataFrame, tree: metric_tree.Tree) -> DataFrame:
    """The points with their leaf and their distance to its centre."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x = _matrix(pdf["_v"])
                leaf = tree.leaves_of(x)
                yield pdf.assign(_leaf=leaf.astype("int32"), _r=np.sqrt(((x - tree.centres[leaf]) ** 2).sum(axis=1)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInPandas(run, f"{kinds}, _leaf int, _r double")


class Balls:
    """Number of points of each leaf and the least and largest distance to its centre."""

    def __init__(self, tree: metric_tree.Tree, seen: np.ndarray, routed: DataFrame):
        found = routed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("low"), F.max("_r").alias("high")).toPandas()
        found = found.sort_values("_leaf")  # at most MAX_LEAVES rows
        self.leaf = found["_leaf"].to_numpy()
        self.size, self.low, self.high = (found[c].to_numpy() for c in ("n", "low", "high"))
        self.centres, self.seen = tree.centres[self.leaf], seen

    def _room(self, length: np.ndarray) -> np.ndarray:
        return SLACK * (length[:, None] + np.sqrt((self.centres**2).sum(axis=1))[None, :] + self.high[None, :])

    def within(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each query a radius that surely holds ``k`` points, by the balls and by the points already seen; infinite with fewer points."""
        length = np.sqrt((x * x).sum(axis=1))
        far = metric_tree.distances(x, self.centres) + self.high + self._room(length)
        order = np.argsort(far, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1)
        if held.shape[1] == 0 or held[0, -1] < k:
            return np.full(len(x), np.inf)
        last = (held < k).sum(axis=1)
        out = np.take_along_axis(far, np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0]
        if len(self.seen) >= k:
            kth = np.partition(metric_tree.distances(x, self.seen), k - 1, axis=1)[:, k - 1]
            out = np.minimum(out, kth + SLACK * (length + np.sqrt((self.seen**2).sum(axis=1)).max()))
        return out

    def reached(self, away: np.ndarray, radius: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether a ball comes as near as the query's radius."""
        gap = np.maximum(away - self.high, self.low - away)
        return gap <= radius[:, None] + self._room(length)


def _grouped(queries: DataFrame, tree: metric_tree.Tree, balls: Balls, k: int, radius: float | None) -> DataFrame:
    """The queries ``_q, _v, ...`` with a radius that holds their neighbours and their group ``_leaf, _block``: queries of one or more leaves that are next to each
    other, as many as ``WAVES`` groups a core take, or a part of one large leaf."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                x = _matrix(part["_v"])
                far = balls.within(x, k) if radius is None else np.full(len(part), float(radius))
                yield part.assign(_home=tree.leaves_of(x).astype("int32"), _radius=far)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    found = cut_lineage(queries.mapInPandas(run, f"{kinds}, _home int, _radius double"))
    sizes = sorted((r["_home"], r["n"]) for r in found.groupBy("_home").agg(F.count(F.lit(1)).alias("n")).collect())  # at most MAX_LEAVES rows
    spark = queries.sparkSession
    wanted = math.ceil(sum(n for _, n in sizes) / (WAVES * spark.sparkContext.defaultParallelism))
    most = max(BLOCK_ROWS, min(wanted, CHUNK_ROWS, HELD // max(k, 1)))
    dealt, group, held = [], 0, 0
    for home, n in sizes:
        if held and held + n > most:
            group, held = group + 1, 0
        dealt.append((home, group, max(1, math.ceil(n / most))))
        held += n
    groups = spark.createDataFrame(dealt, "_home int, _leaf int, _parts int")
    block = F.pmod(F.xxhash64("_q"), F.col("_parts")).cast("int")
    return found.join(F.broadcast(groups), "_home").withColumn("_block", block).drop("_home", "_parts")


def _held(asked: DataFrame, routed: DataFrame, balls: Balls) -> DataFrame:
    """The points for each group whose queries may have them as neighbours, ``_at`` the least distance of a query to the centre of their leaf."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], np.ndarray] = {}
        for pdf in parts:
            for key, group in pdf.groupby(["_leaf", "_block"]):
                for start in range(0, len(group), 256):
                    part = group.iloc[start : start + 256]
                    x = _matrix(part["_v"])
                    away = metric_tree.distances(x, balls.centres)
                    go = balls.reached(away, part["_radius"].to_numpy(), np.sqrt((x * x).sum(axis=1)))
                    near = np.where(go, away, np.inf).min(axis=0)
                    best[key] = np.minimum(best[key], near) if key in best else near
        for (leaf, block), near in best.items():
            at = np.flatnonzero(np.isfinite(near))
            yield pd.DataFrame({"_group": np.full(len(at), leaf, "int32"), "_block": np.full(len(at), block, "int32"),
                                "_leaf": balls.leaf[at].astype("int32"), "_at": near[at]})

    met = asked.select("_leaf", "_block", "_v", "_radius").mapInPandas(run, "_group int, _block int, _leaf int, _at double")
    reach = cut_lineage(met.groupBy("_group", "_block", "_leaf").agg(F.min("_at").alias("_at")))
    return routed.drop("_r").join(reach, "_leaf").drop("_leaf").withColumnRenamed("_group", "_leaf")


class Nearest:
    """The k nearest points so far of some queries; no more than about twice as many are kept."""

    def __init__(self, x: np.ndarray, radius: np.ndarray, k: int):
        self.x, self.k, self.limit = x, k, radius.copy()
        self.length = np.sqrt((x * x).sum(axis=1))
        self.lifted = np.column_stack([x, np.ones(len(x))])
        self.parts, self.kept, self.count = [], 0, 0

    def add(self, points: np.ndarray, first: int) -> np.ndarray:
        """Points that become ``first``, ``first + 1``, ...; returns which of them are kept for now."""
        square = (points * points).sum(axis=1)
        room = SLACK * (self.length + np.sqrt(square.max()))
        # |p|^2 - 2 x.p, so that one comparison is left for each pair
        rough = self.lifted @ np.column_stack([-2.0 * points, square]).T
        own = self.length**2

        def passing(limit: np.ndarray):
            return np.divmod(np.flatnonzero(rough <= ((limit + room) ** 2 - own)[:, None]), len(points))

        who, near = passing(self.limit)
        if self.k < len(points) and len(who) > 4 * self.k * len(self.x):
            kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
            who, near = passing(np.minimum(self.limit, np.sqrt(np.maximum(kth + own, 0.0)) + room))
        away = np.empty(len(who))
        for at in range(0, len(who), 100_000):
            some = slice(at, at + 100_000)
            off = points[near[some]] - self.x[who[some]]
            away[some] = np.sqrt((off * off).sum(axis=1))
        keep = away <= self.limit[who]
        who, near, away = who[keep], near[keep], away[keep]
        self.parts.append((who.astype("uint16"), away, near + first))
        self.count += len(who)
        return np.unique(near)

    def full(self) -> bool:
        return self.count > self.kept + max(self.k * len(self.x) // 2, 4096)

    def cut(self, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, point) of all that may still be among the first k; in order and no more than k with the points' ``ids``."""
        who, away, point = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.argsort(who, kind="stable")
        who, away, point = who[order], away[order], point[order]
        held = np.bincount(who, minlength=len(self.x))
        if ids is None and held.max(initial=0) > self.k:
            place = np.arange(len(who)) - np.repeat(np.cumsum(held) - held, held)
            rows = np.full((len(self.x), held.max()), np.inf)
            rows[who, place] = away
            self.limit = np.minimum(self.limit, np.partition(rows, self.k - 1, axis=1)[:, self.k - 1])
            keep = away <= self.limit[who]
            who, away, point = who[keep], away[keep], point[keep]
        elif ids is not None:
            order = np.lexsort((ids[point], away, who))
            who, away, point = who[order], away[order], point[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < self.k
            who, away, point = who[keep], away[keep], point[keep]
        self.parts, self.kept, self.count = [(who, away, point)], len(who), len(who)
        return who, away, point


class _Near:
    """The nearest points of one group's queries; the carried columns of points that may be neighbours are kept beside them."""

    def __init__(self, pa, queries, k: int, carry: Sequence[str]):
        self.pa, self.carry, self.k = pa, ["_id", *carry], k
        x, radius = _vectors(queries["_v"]), queries["_radius"].to_numpy(zero_copy_only=False)
        self.ids = queries["_id"]
        self.chunks = [Nearest(x[at : at + 256], radius[at : at + 256], k) for at in range(0, len(x), 256)]
        self.tables, self.size, self.floor = [], 0, 0

    def add(self, batch) -> None:
        x = _vectors(batch["_v"])
        used = np.zeros(len(x), bool)
        found = []
        for chunk in self.chunks:
            used[chunk.add(x, 0)] = True
            found.append(chunk.parts[-1])
        place = np.cumsum(used) - 1 + self.size  # points that nobody wants get no number
        for chunk, (who, away, point) in zip(self.chunks, found, strict=True):
            chunk.parts[-1] = (who, away, place[point])
            if chunk.full():
                chunk.cut()
        self.tables.append(self.pa.table({c: batch[c] for c in self.carry}).filter(self.pa.array(used)))
        self.size += int(used.sum())
        if self.size > max(2 * self.floor, 1_000_000):
            self._tidy()

    def _tidy(self) -> None:
        """Forget the points that are no longer among anybody's nearest."""
        used = np.zeros(self.size, bool)
        for chunk in self.chunks:
            used[chunk.cut()[2]] = True
        place = np.cumsum(used) - 1
        for chunk in self.chunks:
            chunk.parts = [(who, away, place[point]) for who, away, point in chunk.parts]
        self.tables = [self.pa.concat_tables(self.tables).filter(self.pa.array(used)).combine_chunks()]
        self.size = self.floor = int(used.sum())

    def rows(self):
        if not self.tables:
            return
        points = self.pa.concat_tables(self.tables).combine_chunks()
        ids = points["_id"].to_pandas().to_numpy()
        for at, chunk in enumerate(self.chunks):
            who, away, point = chunk.cut(ids)
            place = np.arange(len(who)) - np.searchsorted(who, who) + 1
            near = points.take(self.pa.array(point))
            own = self.ids.take(self.pa.array(who.astype("int64") + 256 * at))
            for b in self.pa.table([own, self.pa.array(away), *near.columns, self.pa.array(place.astype("int32"))],
                                   names=["_q", "distance", "_t", *self.carry[1:], "rn"]).to_batches(max_chunksize=65_536):
                yield b


def _streamed(asked: DataFrame, held: DataFrame, carry: Sequence[str], make: Callable, schema: str) -> DataFrame:
    """The rows of ``make(pyarrow, queries)`` for each group, after its points were added to it batch by batch, those of near leaves first.

    A group's queries stand before its points in its task, which holds the queries and a batch of points at a time.
    """
    kinds = dict(held.dtypes)
    columns = [*carry, *[c for c in asked.columns if c not in ("_q", "_v", "_leaf", "_block") and c not in carry]]
    kinds = {**dict(asked.dtypes), **kinds}

    def told(df: DataFrame, id: str, at) -> DataFrame:
        more = [(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in columns]
        return df.select("_leaf", "_block", at.cast("double").alias("_at"), F.col(id).cast(kinds["_t"]).alias("_id"), "_v", *more)

    stored = cut_lineage(asked)
    groups = stored.select("_leaf", "_block").distinct().count()
    rows = told(stored, "_q", F.lit(-1.0)).unionByName(told(held, "_t", F.col("_at")))
    rows = rows.repartition(max(1, 4 * groups), "_leaf", "_block").sortWithinPartitions("_leaf", "_block", "_at")

    def run(batches):
        import pyarrow as pa

        key, waiting, work = None, [], None

        def started():
            return make(pa, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, block, at = (batch[c].to_numpy(zero_copy_only=False) for c in ("_leaf", "_block", "_at"))
            ends = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0) | ((at[1:] < 0) != (at[:-1] < 0))) + 1
            for a, b in zip([0, *ends], [*ends, len(at)], strict=True):
                mine = (leaf[a], block[a])
                if mine != key:
                    if work is not None:
                        yield from work.rows()
                    key, waiting, work = mine, [], None
                part = batch.slice(a, b - a)
                if at[a] < 0:
                    waiting.append(part)
                elif waiting or work is not None:
                    if work is None:
                        work, waiting = started(), []
                    for low in range(0, part.num_rows, 4096):
                        work.add(part.slice(low, 4096))
        if work is not None:
            yield from work.rows()

    return rows.mapInArrow(run, schema)


def _measured(asked: DataFrame, held: DataFrame, k: int, carry: Sequence[str]) -> DataFrame:
    """``_q, distance, _t, carry..., rn``: the k nearest points of each query within its radius."""
    kinds, carried = dict(held.dtypes), list(carry)
    schema = ", ".join([f"_q {kinds['_t']}", "distance double", f"_t {kinds['_t']}", *[f"`{c}` {kinds[c]}" for c in carried], "rn int"])
    return _streamed(asked, held, carried, lambda pa, queries: _Near(pa, queries, k, carried), schema)


def _first_k(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_t"))
    return rows.withColumn("rn", place).filter(F.col("rn") <= k)


def _kept_vector(df: DataFrame, vector: str):
    """The vector in doubles, or as it is in floats, half as long to exchange."""
    kind = dict(df.dtypes)[vector]
    return F.col(vector).cast("array<float>" if kind == "array<float>" else "array<double>").alias("_v")


def nearest(
    queries: DataFrame, points: DataFrame, k: int, id: str, vector: str, carry: Sequence[str] = ()
) -> DataFrame:
    """(id, rn, distance, neighbor, carry...): the k nearest points of every query.

    ``carry`` columns come from the neighbour. Equal distances are ordered by id; a
    point that is also a query is its own first neighbour.
    """
    pts = points.select(F.col(id).alias("_t"), _kept_vector(points, vector), *carry)
    qs = queries.select(F.col(id).alias("_q"), _kept_vector(points, vector))
    copy = F.row_number().over(Window.partitionBy("_v").orderBy("_t"))
    pts = cut_lineage(pts.withColumn("_copy", copy).filter(F.col("_copy") <= k).drop("_copy"))
    count = pts.count()
    if count == 0 or qs.isEmpty():
        raise ValueError("nearest needs at least one point and one query")
    tree, seen = grown_tree(pts, count)
    routed = cut_lineage(_routed(pts, tree))
    balls = Balls(tree, seen, routed)
    asked = cut_lineage(_grouped(qs, tree, balls, k, None))
    ranked = _measured(asked, _held(asked, routed, balls), k, carry)
    if not qs.groupBy("_q").count().filter("count > 1").isEmpty():  # an id of several rows has one list
        ranked = _first_k(ranked.drop("rn"), k)
    return ranked.select(F.col("_q").alias(id), "rn", "distance", F.col("_t").alias("neighbor"), *carry)


def descent_graph(points: DataFrame, id: str, vector: str, k: int, pool: int = 40, rounds: int = 12, least: float = 0.001, leaf_rows: int = 64) -> DataFrame:
    """(id, neighbor) edges to k near points, the point itself included, by descent over bounded lists; may miss some.

    The lists start inside the leaves of ``TREES`` metric trees over different samples. In a round every point introduces its neighbours, and those that have it as
    one of theirs (the nearest ``pool`` of them), to each other, and each list keeps its ``pool`` nearest, of which the first k are the
    edges. Rounds end when fewer than ``least`` of all entries change. ``nearest`` is the exact way.
    """
    kind = dict(points.dtypes)[id]
    pts = cut_lineage(points.select(F.col(id).alias("_t"), _kept_vector(points, vector)))
    count = pts.count()

    def dealt(seed: int) -> DataFrame:
        """The points with their leaf of one tree; a leaf above leaf_rows points is cut into groups by hash, so no group grows with a leaf."""
        leaves = max(1, min(MAX_LEAVES, count // leaf_rows))
        rows = pts.orderBy(F.xxhash64("_t", F.lit(seed)), "_t").limit(leaves * metric_tree.SAMPLE_ROWS).select("_v").collect()
        routed = cut_lineage(_routed(pts, metric_tree.build(np.array([r["_v"] for r in rows], dtype=float), leaves)))
        groups = routed.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf_rows)).alias("_groups"))
        return routed.join(groups, "_leaf").withColumn("_g", F.pmod(F.xxhash64("_t", F.lit(seed)), F.col("_groups")))

    def pairs(ids: np.ndarray, x: np.ndarray, limits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, other, distance): for each member of a group its k nearest others, only those nearer than its limit."""
        d = metric_tree.distances(x, x)
        np.fill_diagonal(d, np.inf)
        if limits is not None:
            d[d >= limits[:, None]] = np.inf
        full = np.flatnonzero(np.isfinite(d).sum(axis=1) > own)
        if len(full):  # all but the nearest go
            np.put_along_axis(rest := d[full], np.argsort(rest, axis=1, kind="stable")[:, own:], np.inf, axis=1)
            d[full] = rest
        who, near = np.nonzero(np.isfinite(d))
        away = x[who] - x[near]
        return ids[who], ids[near], np.sqrt((away * away).sum(axis=1))

    def start(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("_q", "_t", "distance"), pairs(group["_t"].to_numpy(), _matrix(group["_v"]), None), strict=True)))

    def meet(batches):
        """All groups of a partition, whose rows are sorted by group; a batch ends within a group as a rule, which waits for the next one."""
        import pyarrow as pa

        def measured(table):
            q, ids, limits = (table[c].to_numpy() for c in ("_q", "_t", "_limit"))
            x = _vectors(table["_v"].combine_chunks())
            edges = np.flatnonzero(q[1:] != q[:-1]) + 1
            found = [pairs(ids[a:b], x[a:b], limits[a:b]) for a, b in zip([0, *edges], [*edges, len(q)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], names=["_q", "_t", "distance"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            q = held["_q"].to_numpy()
            last = int(np.searchsorted(q, q[-1]))
            if last:
                yield measured(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield measured(held)

    schema = f"_q {kind}, _t {kind}, distance double"
    own = max(pool, k - 1)
    found = reduce(DataFrame.unionByName, [dealt(seed).groupBy("_leaf", "_g").applyInPandas(start, schema) for seed in range(TREES)])
    lists = cut_lineage(_first_k(found.groupBy("_q", "_t").agg(F.min("distance").alias("distance")), own).drop("rn"))
    for _ in range(rounds):
        far = lists.groupBy("_q").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_n"))
        limit = F.when(F.col("_n") >= own, F.col("_far")).otherwise(F.lit(math.inf))
        members = pts.join(far.withColumnRenamed("_q", "_t"), "_t", "left").select("_t", "_v", F.coalesce(limit, F.lit(math.inf)).alias("_limit"))
        back = lists.select(F.col("_t").alias("_q"), F.col("_q").alias("_t"), "distance")
        back = _first_k(back, own).select("_q", "_t")
        met = lists.select("_q", "_t").unionByName(back).unionByName(pts.select(F.col("_t").alias("_q"), "_t")).distinct()
        found = met.join(members, "_t").repartition("_q").sortWithinPartitions("_q", "_t").mapInArrow(meet, schema)
        every = lists.withColumn("_old", F.lit(1)).unionByName(found.withColumn("_old", F.lit(0)))
        every = every.groupBy("_q", "_t").agg(F.min("distance").alias("distance"), F.max("_old").alias("_old"))
        lists = cut_lineage(_first_k(every, own).drop("rn"))
        new = lists.filter("_old = 0").count()
        lists = lists.drop("_old")
        if new <= least * count * own:
            break
    every = _first_k(lists, k - 1).select("_q", "_t").unionByName(pts.select(F.col("_t").alias("_q"), "_t"))
    return every.select(F.col("_q").alias(id), F.col("_t").alias("neighbor"))


BUCKET_SHARE = 1.0  # bucket length in spreads of one coordinate
RECALL = 0.95  # wanted share of the pairs at exactly the radius; closer pairs are found more often

# Neighbour counts of the share columns.
NEIGHBOR_COUNTS = [2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]


def neighbor_shares(
    queries: DataFrame, points: DataFrame, id: str, vector: str, label: str, counts: Sequence[int] = NEIGHBOR_COUNTS
) -> DataFrame:
    """Share of class 1 among the nearest n points, for every n in one pass."""
    near = nearest(queries, points, max(counts), id, vector, [label])
    return near.groupBy(id).agg(
        *[F.avg(F.when(F.col("rn") <= n, F.col(label))).alias(f"knn_{n}_neighbors") for n in counts]
    )


def _tables(radius: float, width: int, bucket: float, recall: float) -> int:
    """Tables in which two points ``radius`` apart share a bucket at least once with probability ``recall``.

    A projection on a random unit vector moves them apart by about a normal value of deviation radius / sqrt(width),
    and two values d apart share a bucket of length b with probability max(0, 1 - d / b).
    """
    t = bucket * math.sqrt(width) / radius if radius > 0 else math.inf
    if math.isinf(t):
        return 1
    shared = math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * -math.expm1(-t * t / 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-shared))) if shared < 1 else 1


def approximate_neighbors(
    queries: DataFrame, points: DataFrame, id: str, vector: str, radius: float, bucket: float | None = None,
    tables: int | None = None, recall: float = RECALL,
) -> DataFrame:
    """Pairs of different points within ``radius`` found by random-projection hashing; may miss some.

    A random projection of a vector has the spread of one coordinate, so buckets are by default
    a share of that spread, whatever the vectors' scale. The number of tables follows from the radius, the width
    of the vectors and the bucket length, so that a pair is missed with probability 1 - ``recall`` at most.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def vectors(df):
        return df.select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))

    if bucket is None or tables is None:
        square = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
        spread, width = points.agg(F.avg(square / F.size(vector)), F.max(F.size(vector))).first()
        bucket = bucket or BUCKET_SHARE * math.sqrt(spread or 1.0)
        tables = tables or _tables(radius, width or 1, bucket, recall)
    lsh = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=1)
    model = lsh.fit(vectors(points))

    def hashed(df: DataFrame, name: str) -> DataFrame:
        found = model.transform(df.select(F.col(id).alias(name), F.col(vector).alias("_own"), array_to_vector(F.col(vector).cast("array<double>")).alias("_v")))
        buckets = F.array(*[vector_to_array(F.col("_h")[i])[0] for i in range(tables)])
        return found.select(name, buckets.alias("_h"), _kept_vector(found, "_own"))

    pts, qs = cut_lineage(hashed(points, "_t")), cut_lineage(hashed(queries, "_q"))
    count = pts.count()
    if not count or qs.isEmpty():
        return queries.select(id, F.col(id).alias("neighbor"), F.lit(0.0).alias("distance")).limit(0)
    tree, seen = grown_tree(pts, count)
    routed = cut_lineage(_routed(pts, tree))
    balls = Balls(tree, seen, routed)
    asked = cut_lineage(_grouped(qs, tree, balls, 1, radius))
    kind = dict(pts.dtypes)["_t"]
    pairs = _streamed(asked, _held(asked, routed, balls), ["_h"], lambda pa, own: _Within(pa, own, radius), f"_q {kind}, _t {kind}, distance double")
    return pairs.filter("_q <> _t").distinct().select(F.col("_q").alias(id), F.col("_t").alias("neighbor"), "distance")


class _Within:
    """The points within a distance of one group's queries that share a bucket with them."""

    def __init__(self, pa, queries, radius: float):
        self.pa, self.ids, self.radius = pa, queries["_id"], radius
        self.x, self.h = _vectors(queries["_v"]), _vectors(queries["_h"])
        self.found = []

    def add(self, batch) -> None:
        x, h = _vectors(batch["_v"]), _vectors(batch["_h"])
        for at in range(0, len(self.x), 256):
            near = Nearest(self.x[at : at + 256], np.full(len(self.x[at : at + 256]), self.radius), len(x))
            near.add(x, 0)
            who, away, point = near.parts[0]
            who = who.astype("int64") + at
            keep = np.concatenate([(self.h[who[i : i + 100_000]] == h[point[i : i + 100_000]]).any(axis=1) for i in range(0, max(len(who), 1), 100_000)])
            if keep.any():
                self.found.append((self.ids.take(self.pa.array(who[keep])), batch["_id"].take(self.pa.array(point[keep])), self.pa.array(away[keep])))
                if len(self.found) > 64:
                    self.found = [tuple(self.pa.concat_arrays([f[i] for f in self.found]) for i in range(3))]

    def rows(self):
        for ids, points, away in self.found:
            yield self.pa.RecordBatch.from_arrays([ids, points, away], names=["_q", "_t", "distance"])


RESIDUAL = 1e-12  # rounds end when no share has moved by more since the last table was written
GRAPH_NEIGHBORS = 7  # fixed value: neighbours per node of the propagation graph


def neighbor_graph(points: DataFrame, id: str, vector: str, k: int = GRAPH_NEIGHBORS) -> DataFrame:
    """(id, neighbor) edges to the k nearest points, the point itself included."""
    return nearest(points, points, k, id, vector).select(id, "neighbor")


def _start(labels: DataFrame, id: str, label: str) -> DataFrame:
    """Class shares per node: certain for labelled nodes, 0 for the others."""
    known = F.col(label).isNotNull()
    return labels.select(
        id, known.alias("_known"),
        F.when(known, F.col(label).cast("double")).otherwise(0.0).alias("_p1"),
        F.when(known, 1.0 - F.col(label).cast("double")).otherwise(0.0).alias("_p0"),
    )


def _moved(edges: DataFrame, state: DataFrame, id: str) -> DataFrame:
    """Weighted sum of the neighbours' shares per node (``_w`` is the edge weight)."""
    there = state.select(F.col(id).alias("neighbor"), "_p0", "_p1")
    return edges.join(there, "neighbor").groupBy(id).agg(
        F.sum(F.col("_w") * F.col("_p0")).alias("_m0"), F.sum(F.col("_w") * F.col("_p1")).alias("_m1")
    )


def _moves(state: DataFrame, before: DataFrame, id: str) -> float:
    """The largest change of a share between two tables of states."""
    old = before.select(id, F.col("_p0").alias("_o0"), F.col("_p1").alias("_o1"))
    change = F.greatest(F.abs(F.col("_p0") - F.col("_o0")), F.abs(F.col("_p1") - F.col("_o1")))
    return state.join(old, id).agg(F.max(change)).first()[0] or 0.0


def _share(name: str):
    return F.try_divide(F.col("_p1"), F.col("_p0") + F.col("_p1")).alias(name)


def label_propagation(
    edges: DataFrame, labels: DataFrame, id: str, label: str, rounds: int = 30, cut_every: int = 5,
    name: str = "label_propagation_knn_kernel", residual: float = RESIDUAL,
) -> DataFrame:
    """Mean of the neighbours' class shares, repeated until nothing moves or ``rounds`` are done; labelled nodes stay fixed."""
    start = cut_lineage(_start(labels, id, label))
    edges = cut_lineage(edges)  # the neighbours are found once
    degree = edges.groupBy(id).agg(F.count(F.lit(1)).alias("_n"))
    weighted = cut_lineage(edges.join(degree, id).select(id, "neighbor", (1 / F.col("_n")).alias("_w")))
    state = written = start
    for done in range(1, rounds + 1):
        new = start.select(id, "_known", F.col("_p0").alias("_s0"), F.col("_p1").alias("_s1")).join(
            _moved(weighted, state, id), id, "left"
        )
        total = F.coalesce(F.col("_m0") + F.col("_m1"), F.lit(0.0))

        def kept(start_col, moved, total=total):
            return F.when(F.col("_known"), F.col(start_col)).when(total > 0, F.col(moved) / total).otherwise(0.0)

        state = new.select(id, kept("_s0", "_m0").alias("_p0"), kept("_s1", "_m1").alias("_p1"))
        if done % cut_every == 0:
            state = cut_lineage(state)
            if _moves(state, written, id) <= residual:
                break
            written = state
    return state.select(id, _share(name))


def label_spreading(
    edges: DataFrame, labels: DataFrame, id: str, label: str, alpha: float = 0.2, rounds: int = 30, cut_every: int = 5,
    name: str = "label_spreading_knn_kernel", residual: float = RESIDUAL,
) -> DataFrame:
    """Neighbours' shares over normalised weights, mixed with the labels at 1 - alpha.

    An edge weighs 1 / sqrt(in-degree of both ends); a node is no neighbour of itself.
    """
    start = cut_lineage(_start(labels, id, label))
    others = cut_lineage(edges.filter(F.col(id) != F.col("neighbor")))  # the neighbours are found once
    degree = others.groupBy(F.col("neighbor").alias("_node")).agg(F.count(F.lit(1)).cast("double").alias("_d"))
    ends = others.join(degree.select(F.col("_node").alias("neighbor"), F.col("_d").alias("_dn")), "neighbor")
    ends = ends.join(degree.select(F.col("_node").alias(id), F.col("_d").alias("_di")), id, "left")
    weight = 1 / F.sqrt(F.col("_dn") * F.coalesce("_di", F.lit(1.0)))
    weighted = cut_lineage(ends.select(id, "neighbor", weight.alias("_w")))
    state = written = start
    for done in range(1, rounds + 1):
        new = start.select(id, F.col("_p0").alias("_s0"), F.col("_p1").alias("_s1")).join(
            _moved(weighted, state, id), id, "left"
        )

        def mixed(start_col, moved):
            return alpha * F.coalesce(moved, F.lit(0.0)) + (1 - alpha) * F.col(start_col)

        state = new.select(id, mixed("_s0", "_m0").alias("_p0"), mixed("_s1", "_m1").alias("_p1"))
        if done % cut_every == 0:
            state = cut_lineage(state)
            if _moves(state, written, id) <= residual:
                break
            written = state
    return state.select(id, _share(name))
