"""Tree ensembles grown by aggregates: extremely randomised trees and multinomial boosting.

A forest is two arrays per tree in heap order (the children of node i are 2i + 1 and 2i + 2). Tasks walk their
rows down the trees an Arrow batch at a time, in batches and streams alike. While trees grow, the rows are stored as
blocks of arrays (an RDD): a level is a short job over them, which plans no query and converts no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.tree_arrays import (
    LEAF, Level, Trees, _below, _binned, _by_bin, _lists, _marks, _matrix, _residuals, _stacked, _summed, averages,
    class_sums, leaves, softmax,
)

# --- rows as blocks of arrays -------------------------------------------------------------------

#: Rows and bytes after which a block ends.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 8 << 20
#: Bytes of all tasks' sums that the driver adds up; larger ones are added in tasks, in so many slices.
SENT_BYTES, SLICES = 4 << 20, 8


def _blocks(rows: DataFrame, pack: Callable[[pa.RecordBatch], tuple]) -> RDD:
    """The arrays that ``pack`` makes of the rows, a tuple for some Arrow batches together."""

    def packed(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(pack(whole), 5)], pa.binary())], names=["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK_ROWS or sum(b.nbytes for b in waiting) >= BLOCK_BYTES:
                yield packed(waiting)
                waiting = []
        if waiting:
            yield packed(waiting)

    return rows.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


@contextmanager
def _storing() -> Iterator[Callable[[RDD], RDD]]:
    """Stores blocks by the first job that reads them; none stays behind, also where a fit fails or is cancelled."""
    held: list[RDD] = []

    def store(blocks: RDD) -> RDD:
        held.append(blocks.persist(StorageLevel.MEMORY_AND_DISK))
        return blocks

    try:
        yield store
    finally:
        for blocks in held:
            if blocks.is_cached:
                blocks.unpersist()


def _merged(blocks: RDD, run: Callable[[Iterator[tuple]], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The array that ``run`` makes of the blocks of a task, merged over the tasks; the driver gets few bytes or one array in all."""
    tasks, none = blocks.getNumPartitions(), run(iter(()))
    if tasks * none.nbytes <= SENT_BYTES:
        return reduce(merge, blocks.mapPartitions(lambda b: [run(b)]).collect(), none)
    sent = blocks.mapPartitions(lambda b: enumerate(np.array_split(run(b), SLICES)))
    found = dict(sent.reduceByKey(merge, SLICES).collect())
    return np.concatenate([found[i] for i in range(SLICES)])


# --- extremely randomised trees -----------------------------------------------------------------


def _per_node(state: DataFrame | RDD, level: Level, classes: int, begin: Sequence[float], fold: Callable, merge: Callable, ordered: bool = False) -> dict[tuple[int, int], np.ndarray]:
    """Every task folds its rows, where ``ordered`` by node, into numbers per node of the level, begun with ``begin``; the nodes that rows were met in."""
    shape = level.feature.shape[:2]

    def run(blocks: Iterator[tuple]) -> np.ndarray:
        total = np.tile(np.array([0.0, *begin]), (*shape, 1))
        for x, there, y, at in blocks:
            x = x.view(np.float64)  # unpickled arrays have a type of their own, for which ufunc.at is slow
            marks, whole = _marks(y, classes), there is None and not np.isnan(x).any()
            for t, nodes in enumerate(at):
                rows = np.flatnonzero(nodes >= level.first)
                if not len(rows):
                    continue
                if ordered and not whole:  # numbers of 16 bits are sorted by their digits
                    rows = rows[np.argsort(nodes[rows], kind="stable")]
                start = rows * x.shape[1]
                place = nodes[rows].astype(np.int64) - level.first
                total[t, np.bincount(place, minlength=shape[1]) > 0, 0] = 1.0

                def read(j: int) -> tuple[np.ndarray, np.ndarray | None]:
                    """The j-th candidate's values of the rows, and which are there."""
                    spot = start + level.feature[t, :, j].take(place)
                    return x.ravel().take(spot), None if there is None else there.ravel().take(spot)

                own = marks if len(rows) == len(y) and (whole or not ordered) else [m[rows] for m in marks]
                fold(total[t, :, 1:], t, read, place, _summed(own, place, shape[1], classes), whole)
        return total.reshape(-1, total.shape[2])

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.column_stack([np.maximum(a[:, :1], b[:, :1]), merge(a[:, 1:], b[:, 1:])])

    blocks = _blocks(state.select("x", "y", "at"), _stacked(classes)) if isinstance(state, DataFrame) else state
    found = _merged(blocks, run, both).reshape(*shape, -1)
    tree, node = np.nonzero(found[:, :, 0])
    return {(t, i + level.first): found[t, i, 1:].copy() for t, i in zip(tree.tolist(), node.tolist())}


def node_ranges(state: DataFrame | RDD, level: Level, classes: int) -> dict[tuple[int, int], np.ndarray]:
    """(tree, node) -> moments, then smallest and largest value of every candidate feature."""
    sums, drawn = classes or 3, level.feature.shape[2]

    def fold(total: np.ndarray, t: int, read: Callable, place: np.ndarray, summed: Callable, whole: bool) -> None:
        total[:, :sums] += summed(None)
        if whole:  # nothing is missing: ranges need no order of the rows
            for j in range(drawn):
                values, least, most = read(j)[0], np.full(len(total), np.inf), np.full(len(total), -np.inf)
                np.minimum.at(least, place, values)
                np.maximum.at(most, place, values)
                here, low, high = least <= most, sums + 2 * j, sums + 2 * j + 1
                total[here, low] = np.fmin(total[here, low], least[here])
                total[here, high] = np.maximum(total[here, high], most[here])
            return
        first = np.flatnonzero(np.diff(place, prepend=-1))
        here = place[first]
        for j in range(drawn):
            values, there = read(j)
            low, high = sums + 2 * j, sums + 2 * j + 1
            # as in Spark NaN is above all numbers, and what is missing is left out
            total[here, low] = np.fmin(total[here, low], np.fmin.reduceat(values, first))
            known = values if there is None else np.where(there, values, -np.inf)
            total[here, high] = np.maximum(total[here, high], np.maximum.reduceat(known, first))

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a + b
        out[:, sums::2] = np.fmin(a[:, sums::2], b[:, sums::2])
        out[:, sums + 1 :: 2] = np.maximum(a[:, sums + 1 :: 2], b[:, sums + 1 :: 2])
        return out

    found = _per_node(state, level, classes, [0.0] * sums + [np.nan, -np.inf] * drawn, fold, merge, ordered=True)
    for row in found.values():
        low, high = row[sums::2], row[sums + 1 :: 2]
        high[np.isnan(low) & np.isneginf(high)] = np.nan
    return found


def split_statistics(state: DataFrame | RDD, level: Level, classes: int) -> dict[tuple[int, int], np.ndarray]:
    """(tree, node) -> moments of the rows left of each candidate's threshold, one row per candidate."""
    sums, drawn = classes or 3, level.feature.shape[2]

    def fold(total: np.ndarray, t: int, read: Callable, place: np.ndarray, summed: Callable, whole: bool) -> None:
        for j in range(drawn):
            total[:, j * sums : (j + 1) * sums] += summed(read(j)[0] <= level.threshold[t, :, j].take(place))

    found = _per_node(state, level, classes, [0.0] * (sums * drawn), fold, np.add)
    return {key: row.reshape(drawn, sums) for key, row in found.items()}


def _size(moments: np.ndarray, classes: int) -> np.ndarray:
    return moments.sum(-1) if classes else moments[..., 0]


def _impurity(moments: np.ndarray, classes: int) -> np.ndarray:
    """Gini impurity or variance, times the number of rows."""
    n = np.maximum(_size(moments, classes), 1e-300)
    out = n - (moments**2).sum(-1) / n if classes else moments[..., 2] - moments[..., 1] ** 2 / n
    return np.maximum(out, 0.0)


def _leaf_value(moments: np.ndarray, classes: int) -> np.ndarray:
    return moments / moments.sum(-1, keepdims=True) if classes else moments[..., 1:2] / moments[..., :1]


def grow_extra(
    data: DataFrame, label: str, classes: int, count: int, depth: int, min_rows: int, seed: int
) -> tuple[Trees, np.ndarray]:
    """Trees on all rows of ``data(features, label)`` and their feature importances.

    Every node draws some features (the square root of their number, for a regression a third) and for each
    one threshold, uniformly between the smallest and largest value in the node; the best of them splits.
    A level takes two aggregates over the rows, ranges and statistics; the driver receives one row per
    node. ``classes`` is 0 for a regression. Draws depend on the seed, the tree and the node only.
    """
    table = data.select(vector_to_array("features").alias("x"), F.col(label).alias("y"))
    first = table.select(F.size("x")).first()
    features = first[0] if first else 0
    drawn = max(1, round(math.sqrt(features)) if classes else features // 3)
    trees = Trees.empty(count, depth, classes or 1)
    importance = np.zeros((count, max(features, 1)))
    with _storing() as store:
        state, before = store(_blocks(table, _stacked(classes, count, depth))), None
        for at in range(depth):
            if not features:
                break
            level = Level(at, np.zeros((count, 2**at, drawn), np.int64))
            random = {}
            # only rows of nodes that were split go on
            open_nodes = np.ones((count, 1), bool) if not at else (trees.feature[:, level.first // 2 : level.first] >= 0).repeat(2, 1)
            for t in range(count):
                for i in np.flatnonzero(open_nodes[t]).tolist():
                    random[t, i] = np.random.default_rng((seed, t, level.first + i))
                    level.feature[t, i] = random[t, i].choice(features, drawn, replace=False)
            found = node_ranges(state, level, classes)
            if before is not None:
                before.unpersist()
            level.threshold = np.zeros(level.feature.shape)
            moments = 3 if not classes else classes
            for (t, node), row in found.items():
                low, high = row[moments::2], row[moments + 1 :: 2]
                level.threshold[t, node - level.first] = low + random[t, node - level.first].random(drawn) * (high - low)
            stats = split_statistics(state, level, classes)
            if not stats:
                break
            (tree, node), rows = np.array(list(stats)).T, np.array([found[key] for key in stats])
            trees.value[tree, node] = _leaf_value(rows[:, :moments], classes)
            left, whole, varies = np.array(list(stats.values())), rows[:, None, :moments], rows[:, moments::2] < rows[:, moments + 1 :: 2]
            right = whole - left
            gain = _impurity(whole, classes) - _impurity(left, classes) - _impurity(right, classes)
            fits = varies & (np.minimum(_size(left, classes), _size(right, classes)) >= min_rows) & (gain > 0)
            here = np.flatnonzero(fits.any(1))
            tree, node, j = tree[here], node[here], np.where(fits, gain, -1.0).argmax(1)[here]
            trees.feature[tree, node], trees.threshold[tree, node] = (v[tree, node - level.first, j] for v in (level.feature, level.threshold))
            for child, part in ((1, left), (2, right)):
                trees.value[tree, 2 * node + child] = _leaf_value(part[here, j], classes)
            np.add.at(importance, (tree, trees.feature[tree, node]), gain[here, j])
            split = len(here)
            if not split:
                break
            if at + 1 < depth:
                before, state = state, store(_descended(state, trees, level))
    total = importance.sum(1, keepdims=True)
    return trees, np.divide(importance, total, out=np.zeros_like(importance), where=total > 0).mean(0)


def _descended(state: RDD, trees: Trees, level: Level) -> RDD:
    """Rows one level further down."""
    here = slice(level.first, level.first + 2**level.depth)
    feature, threshold = trees.feature[:, here], trees.threshold[:, here]

    def move(block: tuple) -> tuple:
        x, there, y, nodes = block
        nodes = nodes.copy()
        for t in range(len(nodes)):
            rows = np.flatnonzero(nodes[t] >= level.first)
            node = nodes[t, rows]
            nodes[t, rows] = _below(feature[t], threshold[t], node.astype(np.int64) - level.first, x.ravel(), rows * x.shape[1], node)
        return x, there, y, nodes

    return state.map(move)


# --- multinomial boosting -----------------------------------------------------------------------


#: Most bins of a feature, points of its distribution they are made from, and bytes of a task's sums per pass.
BINS, POINTS, SUM_BYTES = 32, 1000, 32 << 20
#: Features whose distributions are read in one aggregate.
AT_ONCE = 100
#: Rows that are worth a task of their own: tables of a few tasks' rows are not dealt to more.
TASK_ROWS = 1 << 15


def bin_edges(data: DataFrame, features: int) -> list[np.ndarray]:
    """Thresholds of every feature of ``data(x)``, rising and at most ``BINS`` - 1, from all rows.

    Up to ``BINS`` distinct values are parted one from the other, more into bins of about as many rows each.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = [np.zeros(0)] * features
        for batch in batches:
            x = _matrix(batch.column("x"))
            for j in range(features):
                if len(met[j]) <= BINS:
                    met[j] = np.unique(np.concatenate([met[j], x[:, j]]))[: BINS + 1]
        numbers = np.repeat(np.arange(features, dtype=np.int32), [len(m) for m in met])
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate([np.zeros(0), *met]))], names=["feature", "value"])

    values = data.select("x").mapInArrow(distinct, "feature int, value double").distinct()
    few = values.groupBy("feature").agg(F.collect_list("value").alias("all")).where(F.size("all") <= BINS)
    edges = {r["feature"]: _cuts(np.array(r["all"], float)) for r in few.collect()}
    shares, rest = np.linspace(0, 1, POINTS + 1).tolist(), [j for j in range(features) if j not in edges]
    for first in range(0, len(rest), AT_ONCE):
        some = rest[first : first + AT_ONCE]
        names = [f"x{j}" for j in some]
        points = data.select(*[F.get("x", F.lit(j)).alias(n) for j, n in zip(some, names)]).approxQuantile(names, shares, 0.5 / POINTS)
        edges |= {j: _cuts(np.array(p, float)) for j, p in zip(some, points)}
    return [edges[j] for j in range(features)]


def _cuts(points: np.ndarray) -> np.ndarray:
    values, counts = np.unique(points, return_counts=True)
    middles = values[:-1] / 2 + values[1:] / 2
    if len(values) > BINS:
        ends, goal = np.cumsum(counts), counts.sum() / BINS
        # the border nearest to each multiple of the goal
        borders = np.abs(ends[:-1, None] - goal * np.arange(1, BINS)).argmin(0)
        middles = middles[np.unique(borders)]
    return np.unique(middles[np.isfinite(middles)])


def _bin_sums(state: RDD, steps: Trees, depth: int, wanted: Sequence[int], classes: int) -> tuple[np.ndarray, float]:
    """(class, node of the level, feature, bin) -> rows and their residuals r and |r| (1 - |r|); and the summed log-loss.

    Tasks sum their rows.
    """
    first, nodes, many = 2**depth - 1, 2**depth, len(wanted)
    size = classes * nodes * many * BINS

    def run(blocks: Iterator[tuple]) -> np.ndarray:
        total, loss = np.zeros((3, size)), 0.0
        parts = total.reshape(3, classes, nodes, many, BINS)
        for b, y, raw in blocks:
            r, lost = _residuals(y, raw)
            loss += lost
            columns = np.ascontiguousarray(b.T[list(wanted)])
            for k, leaf in enumerate(leaves(steps, b, depth)):
                inside = leaf >= first
                rows = slice(None) if inside.all() else np.flatnonzero(inside)
                g = r[k][rows]
                h = np.abs(g)
                h *= 1 - h
                parts[:, k] += _by_bin(leaf[rows] - first, columns[:, rows], (None, g, h), nodes, BINS)
        return np.vstack([total.T, [[0.0, loss, 0.0]]])

    out = _merged(state, run, np.add)
    return out[:-1].reshape(classes, nodes, many, BINS, 3), float(out[-1, 1])


def _level(state: RDD, steps: Trees, depth: int, classes: int, features: int) -> tuple[dict[tuple[int, int], tuple], float]:
    """(class, node) -> (feature, bin, gain, left, whole) of the best split, the first of the highest gain; and the summed log-loss.

    ``left`` and ``whole`` are rows, residuals r and |r| (1 - |r|). Wide tables take several passes of ``SUM_BYTES``.
    """
    per_pass = max(1, SUM_BYTES // (classes * 2**depth * BINS * 24))
    found: dict[tuple[int, int], tuple] = {}
    loss = 0.0
    for start in range(0, max(features, 1), per_pass):
        sums, loss = _bin_sums(state, steps, depth, range(start, min(start + per_pass, features)), classes)
        left = sums.cumsum(3)
        whole = left[:, :, :, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sum(x[..., 1] ** 2 / x[..., 0] for x in (left, whole - left)) - whole[..., 1] ** 2 / whole[..., 0]
        gain = np.where((left[..., 0] > 0) & (left[..., 0] < whole[..., 0]), gain, -1.0)
        for k, i in zip(*np.nonzero(whole[:, :, :1, 0, 0].any(2))):
            f, at = np.unravel_index(gain[k, i].argmax(), gain.shape[2:])
            key = int(k), int(i) + 2**depth - 1
            if key not in found or gain[k, i, f, at] > found[key][2]:
                found[key] = start + int(f), int(at), float(gain[k, i, f, at]), left[k, i, f, at], whole[k, i, f, 0]
    return found, loss


def _round(state: RDD, top: dict[tuple[int, int], tuple], classes: int, features: int, depth: int, edges: Sequence[np.ndarray], step: float) -> tuple[Trees, Trees, np.ndarray]:
    """A tree per class on the residuals of ``state``, all grown together, one pass a level: over values, over bins, and importances."""
    steps, importance = Trees.empty(classes, depth, 1), np.zeros((classes, features))

    def newton(sums: np.ndarray) -> float:
        value = (classes - 1) / classes * sums[1] / max(sums[2], 1e-12)
        return step * min(max(value, -LARGEST_STEP), LARGEST_STEP)

    for at in range(depth):
        found = top if at == 0 else _level(state, steps, at, classes, features)[0]
        split = False
        for (t, node), (feature, bin_, gain, left, whole) in found.items():
            if at == 0:
                steps.value[t, node, 0] = newton(whole)
            # sums in floating point leave a trace of gain where there is none
            if gain > 1e-14 * whole[0]:
                steps.feature[t, node], steps.threshold[t, node] = feature, bin_
                steps.value[t, 2 * node + 1, 0], steps.value[t, 2 * node + 2, 0] = newton(left), newton(whole - left)
                importance[t, feature] += gain
                split = True
        if not split:
            break
    trees = Trees(depth, steps.feature.copy(), steps.threshold.copy(), steps.value.copy())
    for t, node in zip(*np.nonzero(steps.feature >= 0)):
        trees.threshold[t, node] = edges[steps.feature[t, node]][int(steps.threshold[t, node])]
    total = importance.sum(1, keepdims=True)
    return trees, steps, np.divide(importance, total, out=np.zeros_like(importance), where=total > 0).sum(0)


#: Shares of a round's step that are tried, the whole first.
SHARES = tuple(0.5**i for i in range(8))
LARGEST_STEP = 4.0


def _added(state: RDD, steps: Trees, classes: int, share: float) -> RDD:
    """``state`` with ``share`` of the trees added to raw."""

    def add(block: tuple) -> tuple:
        b, y, raw = block
        return b, y, raw + share * class_sums(steps, b, classes)

    return state.map(add)


def boost(
    data: DataFrame, label: str, classes: int, rounds: int, depth: int, step: float, seed: int
) -> tuple[Trees, list[float], list[float], np.ndarray]:
    """Multinomial boosting of ``data(features, label)``: trees, starting scores, log-loss before and after each round, importances.

    A round fits one regression tree per class to the residuals of the shared probabilities and gives every
    leaf its Newton step. The trees of a round grow together over values sorted into bins once: a pass over
    the rows per level, that of the first level also giving the log-loss. The round is added whole or, where
    the log-loss would not fall, by the largest share (halves down to 1/128) with which it falls; where none
    does, boosting ends. Nothing is drawn, so ``seed`` changes nothing.
    """
    rows = data.select(vector_to_array("features").alias("x"), F.col(label).alias("y"))
    counts = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    n = sum(counts.values())
    start = [math.log((counts.get(k, 0) + 1) / (n + classes)) for k in range(classes)]
    if not n:
        return Trees.empty(classes, depth, 1), start, [0.0], np.zeros(0)
    features = len(rows.first()["x"])
    rows = rows.coalesce(-(-n // TASK_ROWS))
    edges = bin_edges(rows, features)

    def pack(batch: pa.RecordBatch) -> tuple:
        return _binned(_matrix(batch.column("x")), edges), batch.column("y").to_numpy(zero_copy_only=False), np.tile(start, (batch.num_rows, 1))

    with _storing() as store:
        state = store(_blocks(rows, pack))
        none = Trees.empty(classes, 0, 1)
        top, reached = _level(state, none, 0, classes, features)
        losses, parts, importance = [reached / n], [], None
        for _ in range(rounds):
            here, steps, own = _round(state, top, classes, features, depth, edges, step)
            importance = own if importance is None else importance + own
            following = None
            for share in SHARES:
                tried = store(_added(state, steps, classes, share))
                top_tried, reached = _level(tried, none, 0, classes, features)
                if reached / n < losses[-1]:
                    following = tried
                    break
                tried.unpersist()
            if following is None:
                break
            here.value *= share
            losses.append(reached / n)
            parts.append(here)
            state.unpersist()
            state, top = following, top_tried
    trees = Trees.joined(parts) if parts else Trees.empty(classes, depth, 1)
    if importance is None:
        importance = np.zeros(0)
    return trees, start, losses, importance / max(importance.sum(), 1e-300)


# --- Spark ML stages ----------------------------------------------------------------------------

AVERAGE, SOFTMAX, MEAN = "average", "softmax", "mean"


class TreesModel(Model, MLWritable, MLReadable):
    """A fitted forest: ``average`` of class shares, ``softmax`` of class sums, or the ``mean`` of a regression."""

    def __init__(self, trees: Trees | None = None, kind: str = MEAN, start: Sequence[float] = (),
                 importances: Sequence[float] = (), losses: Sequence[float] = ()):
        super().__init__()
        self.trees, self.kind, self.start = trees, kind, list(start)
        self.importances, self.losses = [float(v) for v in importances], list(losses)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name Spark's tree models have
        return DenseVector(self.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, kind, start = self.trees, self.kind, np.array(self.start)

        def mean(x: pa.Array) -> pa.Array:
            return pa.array(averages(trees, _matrix(x))[:, 0])

        def shares(x: pa.Array) -> pa.Array:
            values = _matrix(x)
            return _lists(averages(trees, values) if kind == AVERAGE else softmax(start + class_sums(trees, values, len(start))))

        if kind == MEAN:
            return dataset.withColumn("prediction", F.arrow_udf(mean, "double")(vector_to_array("features")))
        out = dataset.withColumn("__trees", F.arrow_udf(shares, "array<double>")(vector_to_array("features")))
        # the first of the highest wins
        best = (F.array_position("__trees", F.array_max("__trees")) - 1).cast("double")
        return out.withColumns({"probability": array_to_vector("__trees"), "prediction": best}).drop("__trees")

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader()


class _TreesWriter(MLWriter):
    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m, spark = self.model, self.sparkSession
        extra = {"kind": m.kind, "start": m.start, "importances": m.importances, "losses": m.losses, "depth": m.trees.depth}
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata=extra)
        rows = [(i, *(getattr(m.trees, c)[i].ravel().tolist() for c in ("feature", "threshold", "value"))) for i in range(m.trees.count)]
        spark.createDataFrame(rows, "tree int, feature array<long>, threshold array<double>, value array<double>").coalesce(1).write.parquet(f"{path}/trees")


class _TreesReader(MLReader):
    def load(self, path: str) -> TreesModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()
        feature, threshold, value = (np.array([r[c] for r in rows]) for c in ("feature", "threshold", "value"))
        trees = Trees(meta["depth"], feature, threshold, value.reshape(*feature.shape, -1))
        model = TreesModel(trees, meta["kind"], meta["start"], meta["importances"], meta["losses"])
        return model._resetUid(meta["uid"])


class ExtraTrees(Estimator):
    """Extremely randomised trees; ``classes`` 0 is a regression."""

    def __init__(self, classes: int, trees: int = 20, depth: int = 6, min_rows: int = 1, seed: int = 42, label: str = "label"):
        super().__init__()
        self.settings = (classes, trees, depth, min_rows, seed)
        self.label = label

    def _fit(self, dataset: DataFrame) -> TreesModel:
        trees, importances = grow_extra(dataset, self.label, *self.settings)
        return TreesModel(trees, AVERAGE if self.settings[0] else MEAN, importances=importances)


class SoftmaxBoosting(Estimator):
    """Multinomial boosting of two or more classes."""

    def __init__(self, classes: int, rounds: int = 10, depth: int = 4, step: float = 0.1, seed: int = 42, label: str = "label"):
        super().__init__()
        self.settings = (classes, rounds, depth, step, seed)
        self.label = label

    def _fit(self, dataset: DataFrame) -> TreesModel:
        trees, start, losses, importances = boost(dataset, self.label, *self.settings)
        return TreesModel(trees, SOFTMAX, start, importances, losses)
