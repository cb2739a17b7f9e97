"""What tasks do with blocks of rows and trees: arrays in, arrays out.

Python workers import this module and nothing of Spark's machine learning, which would take each of them seconds and memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LEAF = -1
#: Sums of one weight that two columns at a time may take.
JOINT = 1 << 14


@dataclass
class Trees:
    """``feature`` and ``threshold`` are (tree, node), ``value`` is (tree, node, output); rows with x <= threshold go left."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, count: int, depth: int, outputs: int) -> Trees:
        width = 2 ** (depth + 1) - 1
        return cls(depth, np.full((count, width), LEAF, np.int64), np.zeros((count, width)), np.zeros((count, width, outputs)))

    @classmethod
    def joined(cls, parts: Sequence[Trees]) -> Trees:
        return cls(parts[0].depth, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("feature", "threshold", "value")))

    @property
    def count(self) -> int:
        return len(self.feature)

    @property
    def width(self) -> int:
        return self.feature.shape[1]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as (row, value); missing values in them become NaN."""
    if column.null_count:
        raise ValueError("rows without a list of values")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1 if len(values) else 0)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def _below(feature: np.ndarray, threshold: np.ndarray, place: np.ndarray, values: np.ndarray, start: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The next node of every row; ``place`` is where its node is in the arrays of the tree, ``start`` where its values start."""
    f = feature.take(place)
    left = values.take(start + f) <= threshold.take(place)
    return np.where(f < 0, node, 2 * node + 2 - left)


def leaves(trees: Trees, x: np.ndarray, depth: int | None = None) -> np.ndarray:
    """(tree, row): the leaf of every tree for every row of feature values, or the node ``depth`` steps down."""
    out = np.zeros((trees.count, len(x)), np.int64)
    values, start = x.ravel(), np.arange(len(x)) * x.shape[1]
    for t in range(trees.count):
        if (trees.feature[t] >= 0).any():
            for _ in range(trees.depth if depth is None else depth):
                out[t] = _below(trees.feature[t], trees.threshold[t], out[t], values, start, out[t])
    return out


def averages(trees: Trees, x: np.ndarray) -> np.ndarray:
    """(row, output): the mean of the leaf values over the trees."""
    total = np.zeros((len(x), trees.value.shape[2]))
    for t, leaf in enumerate(leaves(trees, x)):
        total += trees.value[t, leaf]
    return total / trees.count


def class_sums(trees: Trees, x: np.ndarray, classes: int) -> np.ndarray:
    """(row, class): the sum of the class's trees; tree t belongs to class t % classes and has one output."""
    total = np.zeros((len(x), classes))
    for t, leaf in enumerate(leaves(trees, x)):
        total[:, t % classes] += trees.value[t, leaf, 0]
    return total


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Level:
    """Candidates of one level, (tree, node of the level, candidate): features, and thresholds once drawn."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray | None = None

    @property
    def first(self) -> int:
        return 2**self.depth - 1


def _stacked(classes: int, count: int = 0, depth: int = 0) -> Callable[[pa.RecordBatch], tuple]:
    """Rows of ``x``, ``y`` (and ``at``, or all at the roots of ``count`` trees of ``depth``) as values, which of them are there, targets and nodes by tree."""

    def pack(batch: pa.RecordBatch) -> tuple:
        x, lists = _matrix(batch.column("x")), batch.column("x").flatten()
        there = np.reshape(lists.is_valid().to_numpy(zero_copy_only=False), x.shape) if lists.null_count else None
        # a missing target adds to the count of a regression only, and to no class
        target = batch.column("y") if classes else batch.column("y").fill_null(0.0)
        at = np.zeros((count, len(x)), np.int16 if depth < 14 else np.int32) if count else np.ascontiguousarray(_matrix(batch.column("at")).T)
        return x, there, target.to_numpy(zero_copy_only=False), at

    return pack


def _marks(y: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """What rows add to their node: their class, one beyond the last for no class, or target and its square."""
    if classes:
        return (np.where((y >= 0) & (y < classes) & (y == np.floor(y)), y, classes).astype(np.int64),)
    return y, y * y


def _summed(marks: Sequence[np.ndarray], place: np.ndarray, nodes: int, classes: int) -> Callable[[np.ndarray | None], np.ndarray]:
    """Rows (all, or those of a mask) to class counts, or count, sum and sum of squares of the target, as (node, moment)."""
    if classes:
        key, size = place * (classes + 1) + marks[0], nodes * (classes + 1)
        return lambda chosen: np.bincount(key, chosen, size).reshape(nodes, -1)[:, :classes]

    def moments(chosen: np.ndarray | None) -> np.ndarray:
        parts = (None, *marks) if chosen is None else (chosen, *(chosen * m for m in marks))
        return np.column_stack([np.bincount(place, w, nodes) for w in parts])

    return moments


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """(row, feature): the number of thresholds below the value, so x <= edges[k] is bin <= k."""
    out = np.zeros(x.shape, np.int8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j])
    return out


def _residuals(y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, float]:
    """(class, row): own class or not, less the probability; and the summed log-loss."""
    p = np.ascontiguousarray(raw.T)
    if p.base is not None or p is raw:  # the rows of a block stay as they are
        p = p.copy()
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    code = y.astype(int)
    known = np.flatnonzero((code >= 0) & (code < len(p)))
    own = p[code[known], known]
    r = np.negative(p, out=p)
    r[code[known], known] = 1.0 - own
    lost = -np.log(np.maximum(own, 1e-300)).sum() - (len(code) - len(known)) * np.log(1e-300)
    return r, float(lost)


def _by_bin(node: np.ndarray, columns: np.ndarray, weights: Sequence[np.ndarray | None], nodes: int, bins: int) -> np.ndarray:
    """(weight, node, column, bin): sums of the weights, None for a count, over the rows.

    Two columns are counted at a time, by both their bins, while these sums are few enough to stay near the processor.
    """
    out = np.zeros((len(weights), nodes, len(columns), bins))
    if nodes * bins * bins > JOINT:
        for j, column in enumerate(columns):
            at = node * bins + column
            for m, w in enumerate(weights):
                out[m, :, j] = np.bincount(at, w, nodes * bins).reshape(nodes, bins)
        return out
    for j in range(0, len(columns) - 1, 2):
        at = (node * bins + columns[j]) * bins + columns[j + 1]
        for m, w in enumerate(weights):
            both = np.bincount(at, w, nodes * bins * bins).reshape(nodes, bins, bins)
            out[m, :, j], out[m, :, j + 1] = both.sum(2), both.sum(1)
    if len(columns) % 2:
        at = node * bins + columns[-1]
        for m, w in enumerate(weights):
            out[m, :, -1] = np.bincount(at, w, nodes * bins).reshape(nodes, bins)
    return out
