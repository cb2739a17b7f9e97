"""Exact quantiles whose buffers stay bounded.

``percentile`` keeps every distinct value of a column in one buffer, which no task can hold for a
continuous column of a large table. Here the wanted rank is located first: the value range is cut
into ``BINS`` equal bins, the bins are counted (pre-aggregated in every task, at most ``BINS`` rows per
column come back) and only the one or two bins holding the rank are looked into. A bin with more than
``BUFFER_VALUES`` rows is cut again, with equal and logarithmic bins in turn, so skewed and
heavy-tailed columns take a few more rounds, not more memory; a value repeated any number of times
ends up alone in its bin.

Each round reads only the columns still open.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.facts import union_all

BUFFER_VALUES = 200_000
BINS = 2048
# infinities are counted as the largest finite double
LARGEST = 1.7976931348623157e308


def _double(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    # greatest and least pass over NULL, so missing values are kept out first
    finite = F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(c.isNotNull() & ~F.isnan(c), finite)


# below ln of the smallest positive double, so that the logarithmic scale keeps the order of signs
LOG_SHIFT = 746.0


def _bin(v: Column, lo: float, hi: float, bins: int, log: bool) -> Column:
    """Bin of ``v`` within [lo, hi], never falling as ``v`` rises.

    The linear scale uses halves, which keep the width finite. The logarithmic one separates values
    of different magnitude and sign at once, where a far outlier would leave equal bins empty.
    """
    if log:
        v = F.when(v > 0, F.log(v) + LOG_SHIFT).when(v < 0, -(F.log(-v) + LOG_SHIFT)).otherwise(F.lit(0.0))
        lo, hi = (math.copysign(math.log(abs(x)) + LOG_SHIFT, x) if x else 0.0 for x in (lo, hi))
    factor = bins / (hi * 0.5 - lo * 0.5)
    raw = F.floor((v * 0.5 - F.lit(lo * 0.5)) * F.lit(factor))
    return F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")


def _spread(lo: float, hi: float) -> bool:
    """Whether [lo, hi] spans signs or magnitudes enough for the logarithmic scale to help."""
    return lo * hi <= 0 or max(abs(lo), abs(hi)) > 4 * min(abs(lo), abs(hi))


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """(count, min, max) per column; one aggregate."""
    row = df.agg(*[
        e for i, c in enumerate(columns) for e in (
            F.count(_double(c)).alias(f"n{i}"), F.min(_double(c)).alias(f"lo{i}"), F.max(_double(c)).alias(f"hi{i}"),
        )
    ]).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def _clamp(v: float) -> float:
    return max(min(v, LARGEST), -LARGEST)


def _restore(v: float) -> float:
    return math.copysign(math.inf, v) if abs(v) == LARGEST else v


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    known: Mapping[str, tuple[int, float | None, float | None]] | None = None,
    buffer_values: int = BUFFER_VALUES,
    bins: int = BINS,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; ``None`` where a column has no value.

    ``known`` = (count, min, max) per column when the caller has them already.
    """
    if not columns:
        return {}
    spans = ranges(df, columns) if known is None else known
    answers: dict[tuple[str, int], float | None] = {}
    # an open question: rank position within the values of [lo, hi], and how many those are
    todo: dict[tuple[str, int], tuple[float, float, float, int]] = {}
    for name in columns:
        n, lo, hi = spans[name]
        for j, q in enumerate(probabilities):
            if n == 0:
                answers[name, j] = None
            elif lo == hi:
                answers[name, j] = lo
            else:
                todo[name, j] = (q * (n - 1), _clamp(lo), _clamp(hi), n)

    turn = 0
    while todo:
        # small enough already: straight to percentile
        place: dict[tuple[str, int], tuple[Column, Column, float, int]] = {}
        # a rank between the last row of a bin and the first of the next: rows of the two bins
        between: dict[tuple[str, int], tuple[Column, Column]] = {}
        brackets = sorted({(k[0], lo, hi) for k, (_, lo, hi, n) in todo.items() if n > buffer_values})
        counted: dict[tuple, list[tuple[int, int]]] = {}
        if brackets:
            parts = []
            for x, (name, lo, hi) in enumerate(brackets):
                v = _double(name)
                parts.append(
                    df.where((v >= lo) & (v <= hi)).groupBy(_bin(v, lo, hi, bins, turn % 2 == 1 and _spread(lo, hi)).alias("bin"))
                    .agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("x"), "bin", "n")
                )
            for r in union_all(parts).collect():
                counted.setdefault(brackets[r["x"]], []).append((r["bin"], r["n"]))
        for key, (pos, lo, hi, n) in todo.items():
            v = _double(key[0])
            if n <= buffer_values:
                place[key] = ((v >= lo) & (v <= hi), v, pos, n)
                continue
            below, first, last, inside, before = 0, None, None, 0, 0
            for b, count in sorted(counted[key[0], lo, hi]):
                if first is None and math.floor(pos) < below + count:
                    first, before = b, below
                if first is not None:
                    last, inside = b, inside + count
                    if math.ceil(pos) < below + count:
                        break
                below += count
            spot = _bin(v, lo, hi, bins, turn % 2 == 1 and _spread(lo, hi))
            hit = (v >= lo) & (v <= hi) & (spot >= first) & (spot <= last)
            place[key] = (hit, v, pos - before, inside)
            if first != last and inside > buffer_values:
                between[key] = (spot == first, spot == last)
        # one branch per question: the filter is compiled and only the rows of its bins reach the
        # aggregate
        keys = list(place)
        parts = []
        for x, k in enumerate(keys):
            inside, v, pos, n = place[k]
            at = min(max(pos / (n - 1), 0.0), 1.0) if n > 1 else 0.0
            answer = F.percentile("v", F.lit(at)) if n <= buffer_values else F.lit(None).cast("double")
            parts.append(
                df.where(inside).select(v.alias("v"), *[c.alias(a) for c, a in zip(between.get(k, (F.lit(False),) * 2), ("left", "right"))])
                .agg(F.lit(x).alias("x"), F.min("v").alias("lo"), F.max("v").alias("hi"), answer.alias("q"),
                     F.max(F.when(F.col("left"), F.col("v"))).alias("lower"), F.min(F.when(F.col("right"), F.col("v"))).alias("upper"))
            )
        found = {keys[r["x"]]: r for r in union_all(parts).collect()}
        left = {}
        for k in keys:
            _, _, pos, n = place[k]
            lo, hi = found[k]["lo"], found[k]["hi"]
            if n <= buffer_values:
                answers[k] = found[k]["q"]
            elif lo == hi:
                answers[k] = lo
            elif k in between:  # cutting on would never part the two values
                share = pos - math.floor(pos)
                answers[k] = (1 - share) * found[k]["lower"] + share * found[k]["upper"]
            else:
                left[k] = (pos, lo, hi, n)
        todo, turn = left, turn + 1
    return {
        name: [None if answers[name, j] is None else _restore(answers[name, j]) for j in range(len(probabilities))]
        for name in columns
    }
