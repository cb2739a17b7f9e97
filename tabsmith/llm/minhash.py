"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every text becomes its set of 5-word shingles and a signature of 128 minima. Texts with the same word
   sequence are one class, represented by its smallest id.
2. Signatures are cut into 32 bands of 4. Representatives that share a band value are candidates; a
   pair of similarity 0.75 shares none with probability (1 - 0.75**4)**32 = 5e-6.
3. Each representative is first compared with the smallest of its bands' members. What these links leave
   in different components inside one band value is compared in blocks, so that no pair between
   components is lost and no pair list of a group is ever built.
4. A comparison reads the signatures batch by batch and stops as soon as the posterior probability of
   reaching the threshold falls below ``miss``; survivors are compared on their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.graph import components
from tabsmith.llm.text import binary, document_shingles, mix, slices, stream, strings, words
from tabsmith.session import cut_lineage, scratch_path

BANDS, ROWS = 32, 4
PERCENT = 75
MISS = 1e-6
BLOCK = 512
#: Band values with at most so many members are compared pair by pair.
FEW = 8

_SCALE = stream(11, BANDS * ROWS) | np.uint64(1)
_SHIFT = stream(12, BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of 128 hash functions over a non-empty set of shingle hashes."""
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * _SCALE + _SHIFT
        np.minimum(low, part.min(axis=0) >> np.uint64(32), out=low)
    return low.astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash per band, different bands never sharing a value by design."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * _SCALE[:ROWS]).sum(axis=1, dtype=np.uint64) + _SHIFT[:BANDS]).view(np.int64)


def least_agreement(threshold: float, miss: float, batches: range) -> dict[int, int]:
    """Smallest number of equal minima among n for which P(similarity >= threshold) is not below ``miss``.

    With a uniform prior the posterior after m of n equal minima is Beta(m + 1, n - m + 1), whose upper
    tail at t equals P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in batches:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _survives(left: np.ndarray, right: np.ndarray, bounds: dict[int, int]) -> np.ndarray:
    """Row numbers of the signature pairs that no batch rules out."""
    alive, done, equal = np.arange(len(left)), 0, np.zeros(len(left), np.int64)
    for n, least in bounds.items():
        equal = equal + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        keep = equal >= least
        alive, equal, done = alive[keep], equal[keep], n
    return alive


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for lo, hi in slices(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            h, _, _, bounds = words(data[offsets[lo] : offsets[hi]], at)
            size, key, sigs = [], [], []
            for i, found in enumerate(document_shingles(h, bounds)):
                found = np.unique(found)
                size.append(len(found))
                if len(found):
                    sequence = h[bounds[i] : bounds[i + 1]].tobytes()
                    key.append(hashlib.blake2b(sequence, digest_size=16).digest())
                    sigs.append(signature(found))
                else:
                    key.append(b"id" + str(ids[lo + i]).encode())
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(size, pa.int64()), binary(key), binary(sigs)],
                ["doc_id", "n_shingles", "key", "sig"],
            )


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i in range(0, len(ids), 2000):
            sigs = batch.column("sig").slice(i, 2000).to_pylist()
            value = [bands(np.frombuffer(s, np.uint32)) for s in sigs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(value)), pa.array(np.repeat(ids[i : i + 2000], BANDS))], ["band", "doc_id"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for lo, hi in slices(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            h, _, _, bounds = words(data[offsets[lo] : offsets[hi]], at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), binary([np.unique(s) for s in document_shingles(h, bounds)])],
                ["doc_id", "shingles"],
            )


def _verify(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                keep.append(_linked(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def _pruned(bounds: dict[int, int]):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
                for c in ("left", "right")
            )
            yield batch.select(["a", "b"]).take(pa.array(_survives(left, right, bounds)))

    return likely


def _few_pairs(bounds: dict[int, int]):
    """Pairs of different components among a few members that the signatures do not rule out."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members").to_pylist():
                ids, of, sigs = _members(members)
                i, j = np.nonzero(np.triu(of[:, None] != of[None, :]))
                alive = _survives(sigs[i], sigs[j], bounds)
                if len(alive):
                    p, q = ids[i[alive]], ids[j[alive]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    return pairs


def _members(members: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, of = (np.array([m[c] for m in members]) for c in ("doc_id", "component"))
    return ids, of, np.frombuffer(b"".join(m["sig"] for m in members), np.uint32).reshape(len(members), -1)


def _block_links(bounds: dict[int, int], percent: int):
    """A spanning forest of the confirmed links between components of two blocks of one band value.

    Without a second block the members of the first are compared with each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                xs, ys = batch.column("xs")[k].as_py(), batch.column("ys")[k].as_py()
                same, ys = not ys, ys or xs
                (a, ca, sa), (b, cb, sb) = _members(xs), _members(ys)
                left, right = ([np.frombuffer(m["shingles"], np.uint64) for m in side] for side in (xs, ys))
                i, j = np.nonzero(ca[:, None] != cb[None, :])
                if same:
                    i, j = i[i < j], j[i < j]
                alive = _survives(sa[i], sb[j], bounds)
                root: dict[int, int] = {}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = x = root[root[x]]
                    return x

                links = []
                for p, q in zip(i[alive].tolist(), j[alive].tolist(), strict=True):
                    u, v = find(int(ca[p])), find(int(cb[q]))
                    if u != v and _linked(left[p], right[q], percent):
                        root[max(u, v)] = min(u, v)
                        links.append((min(a[p], b[q]), max(a[p], b[q])))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets of shingle hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def _shingle_sets(ids: DataFrame, docs: DataFrame, root: str) -> DataFrame:
    """(doc_id, shingles) of the given documents, written."""
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary")
    return docs.sparkSession.read.parquet(_written(sets.dropDuplicates(["doc_id"]), root, "shingle-sets"))


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, root: str) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    table = _shingle_sets(ids, docs, root)
    both = pairs.join(table.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a").join(
        table.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b"
    )
    return both.select("a", "b", "left", "right").mapInArrow(_verify(percent), "a long, b long")


def _written(df: DataFrame, root: str, label: str) -> str:
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def near_duplicates(
    documents: DataFrame, percent: int = PERCENT, miss: float = MISS, root: str | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents(doc_id, text, ...)``.

    Texts are linked when 100 * |A & B| >= percent * |A | B| for their sets of 5-word shingles (A-Z as
    a-z); component_id is the smallest doc_id reachable. A text with fewer words is one shingle; null
    text, empty text and text without words have none and are linked with nothing. Repeated rows give
    repeated results. Rows without doc_id are ignored. Other columns are ignored. An empty table gives
    an empty result. ``doc_id`` must be an integer that names one text. ``root`` is the folder for the
    tables the result is read from.
    """
    spark = documents.sparkSession
    root = root or scratch_path(spark, "minhash")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull())
    sketches = spark.read.parquet(
        _written(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, key binary, sig binary"), root, "sketches")
    )
    classes = cut_lineage(sketches.groupBy("key").agg(F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("rep").alias("doc_id"))
    signed = sketches.where(F.col("n_shingles") > 0).join(reps, "doc_id", "left_semi").select("doc_id", "sig")
    signed = spark.read.parquet(_written(signed.dropDuplicates(["doc_id"]), root, "signatures"))

    rows = signed.mapInArrow(_band_rows, "band long, doc_id long")
    shared = rows.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(shared)
    members = spark.read.parquet(_written(rows.join(shared, "band"), root, "band-members"))

    bounds = least_agreement(percent / 100, miss, range(32, BANDS * ROWS + 1, 32))
    sig = lambda key, name: signed.select(F.col("doc_id").alias(key), F.col("sig").alias(name))
    first = members.where("doc_id <> first").groupBy("doc_id").agg(F.min("first").alias("a"))
    first = first.select("a", F.col("doc_id").alias("b")).join(sig("b", "right"), "b").join(sig("a", "left"), "a")
    likely = cut_lineage(first.select("a", "b", "left", "right").mapInArrow(_pruned(bounds), "a long, b long"))
    links = cut_lineage(_confirmed(likely, docs, percent, root))
    groups = cut_lineage(components(links))

    # members of one band value that are still in different components
    placed = members.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = placed.select("band", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    placed = spark.read.parquet(_written(placed, root, "placed"))
    open_bands = placed.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")
    ).where("low <> high")
    open_bands = cut_lineage(open_bands.select("band", "size"))
    left = placed.select("band", "doc_id", "component").join(open_bands, "band")
    few = left.where(F.col("size") <= FEW).join(signed, "doc_id").groupBy("band").agg(
        F.collect_list(F.struct("doc_id", "component", "sig")).alias("members")
    )
    rest = cut_lineage(few.select("members").mapInArrow(_few_pairs(bounds), "a long, b long").distinct())

    many = left.where(F.col("size") > FEW)
    sets = _shingle_sets(many.select("doc_id").distinct(), docs, root).join(signed, "doc_id")
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    blocks = many.join(sets, "doc_id").select(
        "band", count.alias("blocks"), F.pmod(F.xxhash64("doc_id"), count).cast("int").alias("block"),
        F.struct("doc_id", "component", "sig", "shingles").alias("member"),
    ).groupBy("band", "blocks", "block").agg(F.collect_list("member").alias("members"))
    blocks = spark.read.parquet(_written(blocks, root, "blocks"))
    alone = blocks.select(F.col("members").alias("xs"), F.array().cast(blocks.schema["members"].dataType).alias("ys"))
    wide = blocks.where("blocks > 1")
    meets = wide.select(
        "band", F.col("members").alias("xs"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.col("block").alias("x"),
    ).where("x < block")
    pairs = meets.join(wide.select("band", "block", F.col("members").alias("ys")), ["band", "block"]).select("xs", "ys")
    forest = alone.unionAll(pairs).mapInArrow(_block_links(bounds, percent), "a long, b long")
    more = cut_lineage(_confirmed(rest, docs, percent, root).unionAll(forest))
    if not more.isEmpty():
        groups = components(links.unionAll(more))

    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select(
        "key", F.coalesce("component", "rep").alias("component_id")
    )
    named = spark.read.parquet(_written(named, root, "classes"))
    return sketches.select("doc_id", "n_shingles", "key").join(named, "key").select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


def keep_first(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``documents`` without the rows that are not the first of their near-duplicate group.

    All columns are kept; of repeated rows with one doc_id all stay or go.
    """
    spark = documents.sparkSession
    root = scratch_path(spark, "minhash")
    kept = near_duplicates(documents, percent, root=root).where("kept").select("doc_id").distinct()
    kept = spark.read.parquet(_written(kept, scratch_path(spark, "minhash-kept"), "ids"))
    # from here on only the ids are read: the signatures and sets need no room any more
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return documents.join(kept, "doc_id", "left_semi").select(*documents.columns)
