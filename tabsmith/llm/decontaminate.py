"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact verification.

Windows have as many words as the item they are held against. A window without any 5-word shingle of
the item has similarity 0, so fingerprints are only taken of windows that hold one; of these, a window
cannot reach the threshold with fewer item shingles than the threshold times the item's number.

The 64 bits of a fingerprint are cut into radius + 1 blocks. Two fingerprints within the radius agree in
at least one block, so a table from (block, value) to items returns all of them. What is within the
radius is verified by weighted Jaccard similarity of the shingle counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.text import document_shingles, shingle_hashes, slices, strings, words

SHINGLE = 5
PERCENT = 75
#: Hamming radius: similarity 0.75 differs in 11 of 64 bits on average (deviation 3), and fingerprints
#: of so few shingles spread wider; a miss needs more than 5 deviations.
RADIUS = 28
#: Items held against the documents at once.
ITEMS = 20_000


def _bits(shingles: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash as -1 or 1."""
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def simhash(shingles: np.ndarray) -> np.ndarray:
    """64 booleans: the sign of the summed bits of all shingles, each as often as it occurs."""
    return _bits(shingles).sum(axis=0) > 0


def weighted_similarity(left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """Sums of the smaller and of the larger counts of all shingles."""
    a, na = np.unique(left, return_counts=True)
    b, nb = np.unique(right, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = int(np.minimum(na[i], nb[j]).sum())
    return low, int(na.sum() + nb.sum()) - low


@dataclass
class Benchmark:
    ids: list[int]
    sizes: np.ndarray  # words
    shingles: list[np.ndarray]  # in order
    sorted_shingles: np.ndarray  # of all items
    owners: np.ndarray  # item numbers in the same order
    fingerprints: np.ndarray
    blocks: list[tuple[int, int]]
    index: dict[tuple[int, int], list[int]]

    def near(self, fingerprint: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all items within the radius."""
        found: set[int] = set()
        for k, (lo, hi) in enumerate(self.blocks):
            found.update(self.index.get((k, _value(fingerprint[lo:hi])), ()))
        some = np.array(sorted(found), np.int64)
        return some[(self.fingerprints[some] != fingerprint).sum(axis=1) <= radius] if len(some) else some


def _value(bits: np.ndarray) -> int:
    return int(bits @ (1 << np.arange(len(bits))))


def build(items: list[tuple[int, str]], radius: int = RADIUS) -> Benchmark | None:
    """Index of (item_id, text); items without words are left out, none at all gives None."""
    column = pa.array([t for _, t in items], pa.string())
    h, _, _, bounds = words(*strings(column)) if items else (None, None, None, [0])
    kept = [(i, s, n) for (i, _), s, n in zip(items, document_shingles(h, bounds) if items else [], np.diff(bounds), strict=True) if n]
    if not kept:
        return None
    ids, shingles, sizes = (list(x) for x in zip(*kept, strict=True))
    every = np.concatenate(shingles)
    owners = np.repeat(np.arange(len(ids)), [len(s) for s in shingles])
    order = np.lexsort((owners, every))
    fingerprints = np.array([simhash(s) for s in shingles])
    edges = np.linspace(0, 64, radius + 2).astype(int)
    blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    index = defaultdict(list)
    for n, f in enumerate(fingerprints):
        for k, (lo, hi) in enumerate(blocks):
            index[k, _value(f[lo:hi])].append(n)
    return Benchmark(ids, np.array(sizes), shingles, every[order], owners[order], fingerprints, blocks, dict(index))


def _window_matches(b: Benchmark, h: np.ndarray, hits: np.ndarray, item: int, percent: int, radius: int) -> list[tuple]:
    """(similarity, start) of the windows of one text that match one item; ``hits`` are shared shingles."""
    size, own = int(b.sizes[item]), b.shingles[item]
    n = len(h)
    size_here = min(size, n)
    width = max(size_here - SHINGLE + 1, 1)  # shingles of a window
    need = max(1, -(-percent * len(own) // 100))
    starts = np.arange(max(int(hits[0]) - width + 1, 0), min(int(hits[-1]), n - size_here) + 1)
    shared = np.searchsorted(hits, starts + width) - np.searchsorted(hits, starts)
    out = []
    runs = shingle_hashes(h, SHINGLE) if n >= SHINGLE else shingle_hashes(h, n)
    for start in starts[shared >= need]:
        window = runs[start : start + width] if size_here >= SHINGLE else shingle_hashes(h[start : start + size_here], size_here)
        if item not in b.near(simhash(window), radius):
            continue
        low, high = weighted_similarity(window, own)
        if 100 * low >= percent * high:
            out.append((low / high, int(start), size_here))
    return out


def _found(b: Benchmark, column: pa.Array, percent: int, radius: int) -> Iterator[tuple[int, list[tuple]]]:
    """(row, matches) of the rows of a text column that match an item."""
    data, offsets = strings(column)
    short = sorted(set(b.sizes[b.sizes < SHINGLE].tolist()))
    for lo, hi in slices(offsets):
        h, _, _, bounds = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        hit = np.zeros(len(h), bool)
        for n in (SHINGLE, *short):
            g = shingle_hashes(h, n)
            at = np.minimum(np.searchsorted(b.sorted_shingles, g), len(b.sorted_shingles) - 1)
            hit[: len(g)] |= b.sorted_shingles[at] == g
        for doc in np.unique(np.searchsorted(bounds, np.flatnonzero(hit), "right") - 1):
            found = _document_matches(b, h[bounds[doc] : bounds[doc + 1]], short, percent, radius)
            if found:
                yield lo + int(doc), found


def _matches(shared, percent: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [(ids[i].as_py(), *m) for i, found in _found(shared.value, batch.column("text"), percent, radius) for m in found]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)],
                    ["doc_id", "item_id", "similarity", "start_word", "n_words"],
                )

    return run


def _clean(shared, percent: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _ in _found(shared.value, batch.column("text"), percent, radius)]] = False
            yield batch.filter(pa.array(keep))

    return run


_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())


def _document_matches(b: Benchmark, h: np.ndarray, short: list[int], percent: int, radius: int) -> list[tuple]:
    places = defaultdict(list)
    grams = {n: shingle_hashes(h, n) for n in (SHINGLE, *short) if n <= len(h)}
    if len(h) < SHINGLE:
        grams[len(h)] = shingle_hashes(h, len(h))
    for g in grams.values():
        lo, hi = np.searchsorted(b.sorted_shingles, g), np.searchsorted(b.sorted_shingles, g, "right")
        for at in np.flatnonzero(hi > lo):
            for item in set(b.owners[lo[at] : hi[at]].tolist()):
                places[item].append(int(at))
    out = []
    for item, hits in places.items():
        if 100 * len(hits) < percent * len(b.shingles[item]):
            continue  # even one window with all of them stays below the threshold
        found = _window_matches(b, h, np.sort(np.array(hits)), item, percent, radius)
        if found:
            best = min(found, key=lambda m: (-m[0], m[1]))
            out.append((b.ids[item], *best))
    return sorted(out)


def contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each matching pair.

    ``documents(doc_id, text, ...)``, ``benchmark(item_id, text, ...)``; words are split at blanks, A-Z
    as a-z. A pair matches when a window of the item's number of words (the whole text where that is
    shorter) has a weighted Jaccard similarity of 5-word shingle counts of ``percent`` or more; a text
    with fewer words is one shingle. Ties go to the first window. Nulls, empty texts and rows without
    an id match nothing; repeated rows give repeated pairs. Other columns are ignored; an empty table on
    either side gives an empty result. Items are held against all documents in blocks of 20,000, so what
    is broadcast is bounded whatever the size of the benchmark.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, radius):
        out = out.unionAll(docs.mapInArrow(_matches(spark.sparkContext.broadcast(index), percent, radius), schema))
    return out


def _indexes(benchmark: DataFrame, radius: int) -> Iterator[Benchmark]:
    """Indexes over the items in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n_blocks = max(1, -(-items.count() // ITEMS))
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        index = build([(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()], radius)
        if index is not None:
            yield index


def without_contaminated(
    documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS
) -> DataFrame:
    """``documents`` without the rows that hold a benchmark passage; all columns are kept as they are.

    Rows without doc_id are judged like the others; null and empty texts stay.
    """
    for index in _indexes(benchmark, radius):
        shared = documents.sparkSession.sparkContext.broadcast(index)
        documents = documents.mapInArrow(_clean(shared, percent, radius), documents.schema)
    return documents
