"""A metric tree over vectors: planes that route a point to a leaf, and a ball around each leaf.

The tree is built from a bounded sample, so what every task holds is bounded, too; the balls are measured over all points. A
node is split at the median along the line between two far points of it; equal points always go the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE_ROWS = 8  # sample points of a leaf


@dataclass
class Tree:
    planes: np.ndarray  # one row for each inner node
    cuts: np.ndarray
    children: np.ndarray  # (left, right): the next inner node, or -1 - leaf
    centres: np.ndarray  # one row for each leaf

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row; the planes are walked level by level for all rows at once."""
        at = np.full(len(x), 0 if len(self.planes) else -1)
        while True:
            inner = np.flatnonzero(at >= 0)
            if not len(inner):
                return -1 - at
            node = at[inner]
            side = (x[inner] * self.planes[node]).sum(axis=1) > self.cuts[node]
            at[inner] = self.children[node, side.astype(int)]


def build(sample: np.ndarray, leaves: int) -> Tree:
    """A tree of at most about ``leaves`` leaves."""
    size = max(1, len(sample) // max(leaves, 1))
    planes, cuts, children, centres = [], [], [], []

    def leaf(rows: np.ndarray) -> int:
        centres.append(sample[rows].mean(axis=0))
        return -len(centres)

    waiting = [(np.arange(len(sample)), None)]
    while waiting:
        rows, slot = waiting.pop()
        x = sample[rows]
        made = None
        if len(rows) > size:
            far = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            other = x[((x - far) ** 2).sum(axis=1).argmax()]
            along = (x * (other - far)).sum(axis=1)
            cut = np.partition(along, (len(rows) - 1) // 2)[(len(rows) - 1) // 2]
            right = along > cut
            if not right.any() and (along < cut).any():  # more than half of the points stand at the largest value
                cut = along[along < cut].max()
                right = along > cut
            if right.any():
                made = len(planes)
                planes.append(other - far)
                cuts.append(cut)
                children.append([0, 0])
                waiting += [(rows[~right], (made, 0)), (rows[right], (made, 1))]
        if made is None:
            made = leaf(rows)
        if slot is not None:
            children[slot[0]][slot[1]] = made
    width = sample.shape[1]
    return Tree(np.array(planes).reshape(-1, width), np.array(cuts), np.array(children, int).reshape(-1, 2), np.array(centres).reshape(-1, width))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances; short ones are only right to about 1e-8 of the vectors' length."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))
