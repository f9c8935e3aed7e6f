"""Trees over binned columns, grown level by level from histograms.

A histogram holds three sums over the rows of each node, column and bin: ``g``, ``h`` and a count. For class trees ``g`` is the weight of
class 1 and ``h`` the whole weight, for boosting they are the first and second derivatives of the loss. Several trees grow
at once as roots of one level. Of two siblings only the smaller one is summed, the other is its parent less it.

Rows may be more than fit into memory: arrays of a row's length come from ``room`` and are passed over block by block.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

CELLS = 4_000_000  # cells of the histograms held at a time
ENTRIES = 2_000_000  # values of rows summed in one go
WALKED = 32_768  # places in trees that are moved down together
HELD = 64_000_000  # bytes of an array that is held in memory; larger ones are in a file
TAKEN = 100_000_000  # values of rows taken out of the bins in one go
ROWS = 4_000_000  # rows of a block


def room(shape: int | tuple[int, ...], kind: type) -> np.ndarray:
    """Zeros; above ``HELD`` bytes in a file without a name, which goes with the array."""
    shape = (shape,) if isinstance(shape, (int, np.integer)) else shape
    size = int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize
    if size <= HELD:
        return np.zeros(shape, kind)
    with tempfile.TemporaryFile() as file:
        file.truncate(size)
        return np.memmap(file, kind, "r+", shape=shape)


def blocks(rows: int, most: int | None = None) -> Iterator[tuple[int, int]]:
    most = ROWS if most is None else most
    return ((at, min(at + most, rows)) for at in range(0, rows, most))


def places(rows: int, chosen: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """The rows for which ``chosen`` (of a block) is true, in order; it is asked twice."""
    out, end = room(sum(int(np.count_nonzero(chosen(a, b))) for a, b in blocks(rows)), np.int32 if rows < 2**31 else np.int64), 0
    for a, b in blocks(rows):
        found = np.flatnonzero(chosen(a, b)) + a
        out[end : end + len(found)] = found
        end += len(found)
    return out


@dataclass
class Rule:
    """How a node is split."""

    depth: int = 6
    criterion: str = "second_order"  # or gini, entropy
    min_split: float = 2  # fewest rows of a node that is split
    min_leaf: float = 1  # fewest rows of a child
    min_weight: float = 0.0  # least h of a child
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    node_share: float = 1.0  # share of the columns that a node may choose from
    tree_share: float = 1.0  # share of the columns that a tree may choose from


@dataclass
class Trees:
    """Nodes of all trees; a leaf leads to itself."""

    feature: np.ndarray
    cut: np.ndarray  # rows with a bin above it go to left + 1
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    depth: int

    def leaves(self, bins: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Leaf of each row (down) in each tree (across)."""
        return self._walk(np.ascontiguousarray(bins), roots, self._packed())

    def _packed(self) -> np.ndarray:
        """Left child, cut and column of each node in one number, so that a step down reads a node once."""
        return self.left.astype(np.int64) << 32 | self.cut.astype(np.int64) << 16 | self.feature.astype(np.int64)

    def _walk(self, bins: np.ndarray, roots: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """As ``leaves``; few enough rows at a time that the steps of all trees stay in the processor's cache."""
        node, flat = np.empty((len(bins), len(roots)), np.int64), bins.reshape(-1)
        rows = max(1, WALKED // max(len(roots), 1))
        for at in range(0, len(bins), rows):
            part = np.broadcast_to(roots, node[at : at + rows].shape)
            first = (np.arange(at, at + len(part), dtype=np.int64) * bins.shape[1])[:, None]
            for _ in range(self.depth):
                own = packed.take(part)
                part = (own >> 32) + (flat.take((own & 0xFFFF) + first) > (own >> 16 & 0xFFFF))
            node[at : at + rows] = part
        return node

    def mean(self, bins: np.ndarray) -> np.ndarray:
        return self.total(bins) / max(len(self.roots), 1)

    def total(self, bins: np.ndarray) -> np.ndarray:
        out, bins, packed = np.zeros(len(bins)), np.ascontiguousarray(bins), self._packed()
        step = max(1, 1_000_000 // max(len(bins), 1))
        for at in range(0, len(self.roots), step):
            out += self.value.take(self._walk(bins, self.roots[at : at + step], packed)).sum(axis=1)
        return out

    def importance(self, columns: int) -> np.ndarray:
        return np.bincount(self.feature, weights=self.gain, minlength=columns)

    @staticmethod
    def joined(parts: list[Trees]) -> Trees:
        shift = np.cumsum([0, *[len(p.feature) for p in parts]])
        pick = lambda name: np.concatenate([getattr(p, name) for p in parts])
        moved = lambda name: np.concatenate([getattr(p, name) + s for p, s in zip(parts, shift, strict=False)])
        return Trees(pick("feature"), pick("cut"), moved("left"), pick("value"), pick("gain"), moved("roots"), max(p.depth for p in parts))


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of at most ``bins`` bins of about equal rows for each column; a value at an edge is below it."""
    out = []
    for column in x.T:
        known = np.sort(column[~np.isnan(column)])
        distinct = np.unique(known)
        if len(distinct) <= bins:
            out.append((distinct[1:] + distinct[:-1]) / 2)
        else:
            out.append(np.unique(known[(np.arange(1, bins) * len(known)) // bins - 1]))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value; a missing value is in bin 0."""
    out = np.zeros(x.shape, np.uint8)
    for k, own in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(own, x[:, k], side="left"))
    return out


def _worth(g: np.ndarray, h: np.ndarray, rule: Rule) -> np.ndarray:
    """What a node is worth; a split gains what the children are worth beyond it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if rule.criterion == "second_order":
            pull = np.maximum(np.abs(g) - rule.l1, 0.0)
            return np.where(h + rule.l2 > 0, pull * pull / (h + rule.l2), 0.0) / 2
        p = np.where(h > 0, np.clip(g / h, 0.0, 1.0), 0.0)
        if rule.criterion == "gini":
            return -2 * h * p * (1 - p)
        logs = np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0.0) + np.where(p < 1, (1 - p) * np.log2(np.where(p < 1, 1 - p, 1)), 0.0)
        return h * logs


def _value(g: np.ndarray, h: np.ndarray, rule: Rule) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        if rule.criterion == "second_order":
            return np.where(h + rule.l2 > 0, -np.sign(g) * np.maximum(np.abs(g) - rule.l1, 0.0) / (h + rule.l2), 0.0)
        return np.where(h > 0, g / h, 0.0)


def _sums(x: np.ndarray, node: np.ndarray, nodes: int, width: int, parts: tuple[np.ndarray, ...], out: np.ndarray | None = None) -> np.ndarray:
    """Histograms (part, node, column, bin) of rows with their node, added to ``out``; ``x`` has a row for each column. A part of None counts rows."""
    columns = len(x)
    out = np.zeros((len(parts), nodes, columns, width)) if out is None else out
    step = max(1, ENTRIES // max(columns, 1))
    for at in range(0, len(node), step):
        base = node[at : at + step].astype(np.int64) * width
        weights = [None if v is None else v[at : at + step].astype(float, copy=False) for v in parts]
        for k in range(columns):
            cell = base + x[k, at : at + step]
            for p, v in enumerate(weights):
                out[p, :, k] += np.bincount(cell, weights=v, minlength=nodes * width).reshape(nodes, width)
    return out


@dataclass
class _Growing:
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)


def _best(cells: np.ndarray, rule: Rule, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, column, bin) of the best split of each node, of equal ones the first; a gain of -inf where there is none.

    A split behind an empty bin is that behind the bin before it, so only bins with rows are tried.
    """
    _, nodes, columns, width = cells.shape
    best, column, cut = np.full(nodes, -np.inf), np.zeros(nodes, int), np.zeros(nodes, int)
    whole = cells[:, :, 0].sum(axis=2)
    tried = (cells[2] > 0.5) & allowed[:, :, None] & (whole[2] >= rule.min_split)[:, None, None]
    tried[:, :, -1] = False
    at = np.flatnonzero(tried)
    node = at // (columns * width)
    g, h, n = (np.cumsum(cells[p], axis=2).reshape(-1)[at] for p in range(3))
    over_g, over_h, over_n = (whole[p][node] - low for p, low in enumerate((g, h, n)))
    enough = (np.minimum(n, over_n) >= max(rule.min_leaf, 1) - 1e-6) & (np.minimum(h, over_h) >= rule.min_weight)
    at, node, g, h, over_g, over_h = (v[enough] for v in (at, node, g, h, over_g, over_h))
    if len(at):
        gain = _worth(g, h, rule) + _worth(over_g, over_h, rule) - _worth(whole[0], whole[1], rule)[node]
        found, first = np.unique(node, return_index=True)
        best[found] = np.maximum.reduceat(gain, first)
        top = np.flatnonzero(gain == best[node])
        found, first = np.unique(node[top], return_index=True)
        column[found], cut[found] = np.divmod(at[top[first]] % (columns * width), width)
    return best, column, cut


def _rows(at: np.ndarray, *parts: np.ndarray | None) -> tuple[np.ndarray | None, ...]:
    return tuple(None if v is None else v[at] for v in parts)


def grow(
    bins: np.ndarray, row: np.ndarray | None, tree: np.ndarray | None, g: np.ndarray, h: np.ndarray | None, count: np.ndarray | None, trees: int,
    rule: Rule, rng: np.random.Generator, width: int,
) -> Trees:
    """``trees`` trees at once. Entry i is row ``row[i]`` of ``bins`` (None: row i) in tree ``tree[i]`` (None: the first) with its sums
    ``g, h, count`` (None: 1 each).

    ``bins`` whose columns lie together (Fortran order) are read fastest. Of the entries only their node is kept; values are taken block by block.
    """
    columns = bins.shape[1]
    out = _Growing()
    own = np.ones((trees, columns), bool)
    if rule.tree_share < 1:
        own = np.argsort(np.argsort(rng.random((trees, columns)), axis=1), axis=1) < max(1, int(rule.tree_share * columns))
    size, tree_of = len(g), np.arange(trees)
    parts = list(blocks(size, max(1, min(ROWS, TAKEN // max(columns, 1)))))
    node, total = room(size, np.int32), np.zeros((trees, 3))  # a node of -1: the entry is in its leaf
    if tree is not None:
        for a, b in blocks(size):
            node[a:b] = tree[a:b]

    def going(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(node[a:b] >= 0)
        return at + a, node[a:b][at]

    def sums(cells: int, wanted: Callable[[np.ndarray], np.ndarray], cell: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        found = np.zeros((3, cells, columns, width))
        for a, b in parts:
            at, here = going(a, b)
            mine = wanted(here)
            at, here = at[mine], here[mine]
            _sums(np.take(bins.T, at if row is None else row[at], axis=1), cell(here), cells, width, _rows(at, g, h, count), found)
        return found

    def add_up(at: np.ndarray, here: np.ndarray) -> None:
        for p, v in enumerate((g, h, count)):
            total[:, p] += np.bincount(here, weights=None if v is None else v[at], minlength=len(total))

    for a, b in parts:
        add_up(*going(a, b))
    kept: np.ndarray | None = None  # histograms of the split parents, in the order of the sibling pairs
    for level in range(rule.depth + 1):
        nodes = len(tree_of)
        first = len(out.feature)
        out.feature += [0] * nodes
        out.cut += [width] * nodes
        out.left += range(first, first + nodes)
        out.value += _value(total[:, 0], total[:, 1], rule).tolist()
        out.gain += [0.0] * nodes
        if level == rule.depth or not nodes:
            break
        allowed = own[tree_of]
        if rule.node_share < 1:
            draw = np.where(allowed, rng.random((nodes, columns)), np.inf)
            allowed = np.argsort(np.argsort(draw, axis=1), axis=1) < np.maximum(1, (rule.node_share * allowed.sum(axis=1)).astype(int))[:, None]
        whole_level = nodes * columns * width <= CELLS
        if whole_level and kept is not None:
            pairs = total[:, 2].reshape(-1, 2)
            small = np.arange(0, nodes, 2) + (pairs[:, 1] < pairs[:, 0])
            part = sums(nodes // 2, lambda here: np.flatnonzero(small[here // 2] == here), lambda here: here // 2)
            cells = np.empty((3, nodes, columns, width))
            cells[:, small], cells[:, small ^ 1] = part, kept - part
            best, column, bin_ = _best(cells, rule, allowed)
        elif whole_level:
            cells = sums(nodes, lambda here: slice(None), lambda here: here)
            best, column, bin_ = _best(cells, rule, allowed)
        else:  # a wide level is searched a few nodes at a time, without its histograms being kept
            step, found, cells = max(1, CELLS // (columns * width)), [], None
            for low in range(0, nodes, step):
                high = min(low + step, nodes)
                own_cells = sums(high - low, lambda here: np.flatnonzero((here >= low) & (here < high)), lambda here: here - low)
                found.append(_best(own_cells, rule, allowed[low:high]))
            best, column, bin_ = (np.concatenate(v) for v in zip(*found, strict=True))
        split = np.flatnonzero(best > max(rule.min_gain, 1e-12))
        child = np.full(nodes, -1, np.int64)
        child[split] = 2 * np.arange(len(split))
        for k, s in enumerate(split.tolist()):
            out.feature[first + s], out.cut[first + s] = int(column[s]), int(bin_[s])
            out.left[first + s], out.gain[first + s] = first + nodes + 2 * k, float(best[s])
        total = np.zeros((2 * len(split), 3))
        for a, b in parts:
            at, here = going(a, b)
            to = child[here]
            if (to < 0).any():
                node[at[to < 0]] = -1
                at, here, to = at[to >= 0], here[to >= 0], to[to >= 0]
            to = to + (bins[at if row is None else row[at], column[here]] > bin_[here])
            node[at] = to
            add_up(at, to)
        kept = cells[:, split] if cells is not None else None
        tree_of = np.repeat(tree_of[split], 2)
    return Trees(np.array(out.feature, np.int32), np.array(out.cut, np.int32), np.array(out.left, np.int64), np.array(out.value), np.array(out.gain),
                 np.arange(trees, dtype=np.int64), rule.depth)


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Rank-sum AUC, ties counted half; 0.5 with one class only."""
    order = np.argsort(score, kind="stable")
    values = score[order]
    low, high = np.searchsorted(values, values, side="left"), np.searchsorted(values, values, side="right")
    rank = (low + high + 1) / 2
    ones = label[order] == 1
    n1, n0 = int(ones.sum()), int((~ones).sum())
    return float((rank[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else 0.5


def _auc_at(score: np.ndarray, label: np.ndarray, at: np.ndarray) -> float:
    """``auc`` of the rows ``at``; above a block of them, pairs are counted between sorted runs."""
    if len(at) <= ROWS:
        return auc(score[at], label[at])
    runs: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for a, b in blocks(len(at)):
        values, ones = score[at[a:b]], label[at[a:b]] == 1
        for kind in runs:
            run = room(int((ones == kind).sum()), float)
            run[:] = np.sort(values[ones == kind])
            runs[kind].append(run)
    n1, n0 = (sum(map(len, runs[kind])) for kind in (True, False))
    twice = sum(int(np.searchsorted(zeros, ones, side=side).sum()) for ones in runs[True] for zeros in runs[False] for side in ("left", "right"))
    return twice / 2 / (n1 * n0) if n1 and n0 else 0.5


def boost(
    bins: np.ndarray, y: np.ndarray, held_out: np.ndarray, rule: Rule, rng: np.random.Generator, width: int, rounds: int, step: float,
    row_share: float = 1.0, patience: int | None = None,
) -> tuple[Trees, float, list[float]]:
    """(trees, base score, AUC of the held-out rows by round) of logistic boosting; rounds end ``patience`` after the best one."""
    fit, held = places(len(y), lambda a, b: ~held_out[a:b]), places(len(y), lambda a, b: held_out[a:b])
    mean = sum(float(y[fit[a:b]].sum()) for a, b in blocks(len(fit))) / len(fit)
    rate = float(np.clip(mean, 1e-6, 1 - 1e-6))
    base = float(np.log(rate / (1 - rate)))
    score, first, second = room(len(y), float), room(len(fit), float), room(len(fit), float)
    for a, b in blocks(len(y)):
        score[a:b] = base
    some = fit if row_share >= 1 else room(len(fit), fit.dtype)
    grown, history, best = [], [], -1
    for _ in range(rounds):
        size = len(fit)
        if row_share < 1:
            size = 0
            for a, b in blocks(len(fit)):
                drawn = fit[a:b][rng.random(b - a) < row_share]
                some[size : size + len(drawn)] = drawn
                size += len(drawn)
        for a, b in blocks(size):
            p = 1 / (1 + np.exp(-score[some[a:b]]))
            first[a:b], second[a:b] = p - y[some[a:b]], p * (1 - p)
        tree = grow(bins, some[:size], None, first[:size], second[:size], None, 1, rule, rng, width)
        tree.value *= step
        for a, b in blocks(len(y)):
            score[a:b] += tree.value[tree.leaves(bins[a:b], tree.roots)[:, 0]]
        grown.append(tree)
        if patience is not None:
            history.append(_auc_at(score, y, held))
            best = len(history) - 1 if best < 0 or history[-1] > history[best] else best
            if len(history) - 1 - best >= patience:
                break
    return Trees.joined(grown if patience is None else grown[: best + 1]), base, history


def ada_boost(bins: np.ndarray, y: np.ndarray, rule: Rule, rng: np.random.Generator, width: int, rounds: int) -> Trees:
    """Real-valued AdaBoost (SAMME.R); a tree's value is the log odds of class 1. Rounds end when a tree makes no error."""
    eps = np.finfo(float).eps
    weight, ones, grown = room(len(y), float), room(len(y), float), []
    for a, b in blocks(len(y)):
        weight[a:b] = 1 / len(y)
    for _ in range(rounds):
        for a, b in blocks(len(y)):
            ones[a:b] = weight[a:b] * y[a:b]
        tree = grow(bins, None, None, ones, weight, None, 1, rule, rng, width)
        p = np.clip(tree.value, eps, 1 - eps)
        tree.value = np.log(p) - np.log(1 - p)
        grown.append(tree)
        wrong, total = False, 0.0
        for a, b in blocks(len(y)):
            odds = tree.value[tree.leaves(bins[a:b], tree.roots)[:, 0]]
            wrong |= bool(weight[a:b][(odds > 0) != (y[a:b] == 1)].sum() > 0)
            weight[a:b] *= np.exp(-0.5 * np.where(y[a:b] == 1, odds, -odds))
            total += weight[a:b].sum()
        if not wrong:
            break
        for a, b in blocks(len(y)):
            weight[a:b] /= total
    return Trees.joined(grown)
