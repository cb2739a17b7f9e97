"""Removal of repeated byte strings: suffix sorting by bucket-pointer refinement over q-gram buckets.

A string of 100 bytes is removed where it also starts earlier. Sorting every suffix of a corpus is out
of reach, so buckets are laid out in the cluster first and only open buckets are refined:

1. Every 100-byte string belongs to the bucket of its smallest 32-gram (by hash), which depends on its
   bytes alone. Consecutive strings with one such gram form a segment of at most 69 strings, about one per
   36 bytes of text. Buckets that only one segment has hold no repeat and are left.
2. Of segments equal in all bytes, all but the first are removed whole.
3. Segments that share a bucket and differ are refined: the 8-gram buckets of their positions are sorted
   by the bucket identifiers of later offsets, each round using the identifiers the last one wrote, until
   100 bytes are told apart. Only positions of buckets that are still shared are sorted again.
4. A bucket with many different segments (a very common line) is not refined in one task. Its segments
   are cut into pieces of at most 16 strings, whose buckets are the 85 bytes that the strings of a piece
   have in common, and steps 1 to 3 are done for these. Where such a bucket still has many different
   pieces, each string is a bucket of its own, whose first start is a partial aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.text import binary, fresh, mix, slices, stream, strings
from tabsmith.session import cut_lineage, scratch_path

LENGTH, GRAM = 100, 32
RUN = LENGTH - GRAM + 1  # strings that can share one 32-gram
#: Buckets with more different segments than this are dealt out string by string.
MANY = 256
PIECE = 16
FLUSH = 1 << 20
#: Bytes of text that are hashed at once, which takes about 110 times as much memory, and bytes of segments refined at once.
CHUNK, REFINED = 1 << 18, 1 << 18

_BYTE = stream(21, 256)
_BASE = 0x9E3779B97F4A7C15 | 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 2**64))


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of 2 * size bytes from those of size bytes."""
    m = max(len(h) - size, 0)
    return h[:m] * _power(size) + h[size : size + m]


def _hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    out = {1: _BYTE[data]}
    for size in (1, 2, 4, 8, 16, 32):
        out[2 * size] = _doubled(out[size], size)
    return {n: out[n] for n in (4, 32, 64)}


def _string_hash(h: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Hash of the 100 bytes from each position: 64 + 32 + 4."""
    return mix(h[64][at] * _power(36) + h[32][at + 64] * _power(4) + h[4][at + 96])


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of about ``CHUNK`` bytes; long texts overlap by 99 bytes."""
    for lo, hi in slices(offsets, CHUNK):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= 2 * CHUNK:
            yield lo, hi, a, b
        else:
            for x in range(a, b, CHUNK):
                yield lo, hi, x, min(x + CHUNK + LENGTH - 1, b)


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(bucket, content, row, first start in the text, number of strings) of the segments of each chunk."""
    for lo, hi, a, b in _chunks(offsets):
        part = data[a:b]
        if len(part) < LENGTH:
            continue
        h = _hashes(part)
        gram = low = mix(h[32])
        size = 1
        while size * 2 <= RUN:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if RUN > size:
            low = np.minimum(low[: len(low) - (RUN - size)], low[RUN - size :])
        valid = np.zeros(len(part), bool)
        bounds = np.clip(offsets[lo : hi + 1] - a, 0, len(part))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if y - x >= LENGTH:
                valid[x : y - LENGTH + 1] = True
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        value = low[at]
        new = np.ones(len(at), bool)
        # a string that starts with its smallest gram is the last of its segment, also where grams repeat
        new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (gram[at[:-1]] == value[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        first = at[begin]
        content = mix(
            _string_hash(h, first) * np.uint64(3) + _string_hash(h, first + count - 1) * np.uint64(5)
            + count.astype(np.uint64)
        )
        row = np.searchsorted(bounds, first, "right") - 1 + lo if hi - lo > 1 else np.full(len(first), lo)
        yield value[begin], content, row, first + a - offsets[row], count


def _filter_key(bucket: np.ndarray, parts: int) -> np.ndarray:
    return ((bucket % np.uint64(parts)) << np.uint64(32) | (bucket >> np.uint64(32))).view(np.int64)


def _bucket_counts(parts: int):
    """Per task and part the bucket identifiers, twice where the task holds them more than once."""

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        keys = np.sort(np.concatenate([keys, keys[n > 1]]))
        part = keys >> 32
        cut = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        low = (keys & 0xFFFFFFFF).astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), binary([low[cut[p] : cut[p + 1]] for p in some])], ["part", "low"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for bucket, *_ in _segments(*strings(batch.column("text"))):
                found.append(_filter_key(bucket, parts))
                n += len(bucket)
                if n >= FLUSH:
                    yield packed(found)
                    found, n = [], 0
        if found:
            yield packed(found)

    return run


def _shared_buckets(key: tuple[pa.Scalar, ...], blobs: pa.Table) -> pa.Table:
    low = np.sort(np.frombuffer(b"".join(blobs.column("low").to_pylist()), np.uint32))
    twice = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.int64)
    return pa.table({"filter": twice + (key[0].as_py() << 32)})


def _segment_rows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for bucket, content, row, start, count in _segments(*strings(batch.column("text"))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (
                        _filter_key(bucket, parts), bucket.view(np.int64), content.view(np.int64), ids[row],
                        start * 128 + count,
                    )],
                    ["filter", "bucket", "content", "doc_id", "at"],
                )

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for lo, hi in slices(offsets, 16 * CHUNK):
            packed = [squeeze.compress(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), binary(packed)], ["doc_id", "packed"])


def _bytes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint8)


def _open_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments to refine; segments of very common buckets are cut into pieces."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = _bytes(batch.column("packed")[i].as_py())
            doc = batch.column("doc_id")[i].as_py()
            part = batch.column("open")[i].values
            at, bucket, many = (part.field(c).to_numpy(zero_copy_only=False) for c in ("at", "bucket", "many"))
            start, count = at >> 7, at & 127
            cold = np.flatnonzero(~many)
            if len(cold):
                bodies = [data[start[k] : start[k] + count[k] + LENGTH - 1] for k in cold]
                yield _content_batch(bucket[cold], doc, start[cold], bodies, False)
            pieces = [p for k in np.flatnonzero(many) for p in _pieces(data, int(start[k]), int(count[k]))]
            if pieces:
                keys, starts, bodies = zip(*pieces, strict=True)
                yield _content_batch(np.array(keys), doc, np.array(starts), list(bodies), True)


def _pieces(data: np.ndarray, start: int, count: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(hash of the common bytes, start, bytes) of the pieces of a segment, aligned at its smallest gram."""
    body = data[start : start + count + LENGTH - 1]
    gram = start + int(mix(_hashes(body)[32]).argmin())
    for k in range((gram - start) // PIECE, -1, -1):
        first = max(gram - k * PIECE - PIECE + 1, start)
        end = min(gram - k * PIECE, start + count - 1) + 1
        if first < end:
            shared = data[gram - k * PIECE : gram - k * PIECE - PIECE + 1 + LENGTH].tobytes()
            key = int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True)
            yield key, first, data[first : end + LENGTH - 1]


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, start, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "body")), strict=True):
            n = len(body) - LENGTH + 1
            key = _string_hash(_hashes(np.frombuffer(body, np.uint8)), np.arange(n)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.full(n, doc, np.int64)), pa.array(start + np.arange(n))], ["bucket", "doc_id", "start"]
            )


def _content_batch(bucket, doc, start, bodies, piece: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket), pa.array(np.full(len(bucket), doc, np.int64)), pa.array(start), binary(bodies),
         pa.array(np.full(len(bucket), piece))],
        ["bucket", "doc_id", "start", "body", "piece"],
    )


def _ranks(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense identifiers of the pairs in sorted order, and the size of each pair's bucket."""
    order = np.lexsort((minor, major))
    a, b = major[order], minor[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.cumsum(new) - 1
    ids = np.empty(len(order), np.int64)
    ids[order] = number
    return ids, np.bincount(number)[ids]


def refine(body: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Bucket identifier of the 100 bytes from each position of ``body``; alone ones may differ freely.

    ``bucket`` starts with 8-grams. A round sorts the positions that still share a bucket by the bucket
    at offset ``depth`` and writes the refined identifiers back, where the next round reads them, so the
    depth told apart doubles: 8, 16, 32, 64, then 100 by an offset of 36.
    """
    n = len(body)
    wide = np.zeros(n + LENGTH, np.uint64)
    wide[:n] = body
    gram = np.zeros(n, np.uint64)
    for j in range(8):
        gram = gram << np.uint64(8) | wide[j : n + j]
    _, bucket = np.unique(gram, return_inverse=True)
    bucket = bucket.astype(np.int64)
    size = np.bincount(bucket)
    shared = np.flatnonzero(size[bucket] > 1)  # positions whose bucket is not decided yet
    reach = lambda at, offset: np.minimum(at + offset, n - 1)
    for offset in (8, 16, 32, 36):
        if not len(shared):
            break
        ids, size = _ranks(bucket[shared], bucket[reach(shared, offset)])
        bucket = bucket.copy()
        bucket[shared] = ids + bucket.max() + 1
        shared = shared[size > 1]
    return bucket[position]


def _repeats(bodies: list[bytes], docs: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
    sizes = np.array([len(b) for b in bodies])
    count = sizes - LENGTH + 1
    base = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(len(bodies)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bucket = refine(np.frombuffer(b"".join(bodies), np.uint8), base[seg] + nth)
    doc, start = docs[seg], starts[seg] + nth
    order = np.lexsort((start, doc, bucket))
    b = bucket[order]
    head = np.ones(len(b), bool)
    head[1:] = b[1:] != b[:-1]
    leader = np.flatnonzero(head)[np.cumsum(head) - 1]
    again = (doc[order] != doc[order][leader]) | (start[order] != start[order][leader])
    gone = np.sort(order[again])
    if not len(gone):
        return None
    new = np.ones(len(gone), bool)
    new[1:] = (gone[1:] != gone[:-1] + 1) | (seg[gone[1:]] != seg[gone[:-1]])
    x = np.flatnonzero(new)
    y = np.append(x[1:], len(gone)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[gone[x]]), pa.array(start[gone[x]]), pa.array(start[gone[y]] + LENGTH)], ["doc_id", "lo", "hi"]
    )


def _refine_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the segments of each bucket; rows come sorted by bucket."""
    waiting, n = [], 0

    def settle(rows: list) -> Iterator[pa.RecordBatch]:
        if rows:
            _, docs, starts, bodies = zip(*rows, strict=True)
            out = _repeats(list(bodies), np.array(docs), np.array(starts))
            if out is not None:
                yield out

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "start", "body")), strict=True):
            if n >= REFINED and row[0] != waiting[-1][0]:
                yield from settle(waiting)
                waiting, n = [], 0
            waiting.append(row)
            n += len(row[3])
    yield from settle(waiting)


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs (touching ones are one)."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > top[:-1]
    x = np.flatnonzero(new)
    return lo[x], top[np.append(x[1:], len(lo)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            size, spans, kept = [], [], []
            for packed, marks in zip(part.column("packed"), part.column("marks"), strict=True):
                data = _bytes(packed.as_py())
                size.append(len(data))
                keep, runs = np.ones(len(data), bool), []
                if marks.is_valid:
                    lo, hi = _merged(*(marks.values.field(c).to_numpy() for c in ("lo", "hi")))
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        keep[a:b] = False
                        runs.append({"lo": a, "hi": b})
                spans.append(runs)
                kept.append(data[keep].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``documents(doc_id, text, ...)``.

    A byte of the UTF-8 text is removed when a 100-byte string over it also starts earlier: in a smaller
    doc_id or earlier in the same text, overlaps included, judged on the input. ``spans`` are the maximal
    removed runs [lo, hi) and ``kept`` the remaining bytes (which may cut a character). Null text is
    empty; texts under 100 bytes stay. Rows repeated with the same doc_id are one text and each get its
    result; rows without doc_id are ignored, as are other columns. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull())
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text")
    blobs = texts.mapInArrow(_bucket_counts(parts), "part int, low binary")
    shared = _stored(blobs.groupBy("part").applyInArrow(_shared_buckets, "filter long"), "shared-buckets")
    rows = docs.mapInArrow(_segment_rows(parts), "filter long, bucket long, content long, doc_id long, at long")
    found = _stored(rows.join(shared, "filter").drop("filter"), "segments")
    firsts = _stored(
        found.groupBy("bucket", "content").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")), "firsts"
    )
    again = found.join(firsts.where("n > 1"), ["bucket", "content"]).where(
        F.struct("doc_id", "at") != F.col("first")
    ).select("doc_id", _lo(F.col("at")), _hi(F.col("at")))

    differ = cut_lineage(firsts.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    open_rows = firsts.select("bucket", "first.*").join(differ, "bucket")
    open_rows = open_rows.groupBy("doc_id").agg(
        F.collect_list(F.struct("at", "bucket", (F.col("n") > MANY).alias("many"))).alias("open")
    )
    packed = docs.mapInArrow(_compress, "doc_id long, packed binary")
    bodies = _stored(
        packed.join(open_rows, "doc_id").select("doc_id", "packed", "open")
        .mapInArrow(_open_contents, "bucket long, doc_id long, start long, body binary, piece boolean"),
        "open-segments",
    )
    marks = "doc_id long, lo long, hi long"
    part = bodies.where("piece").select("bucket", F.xxhash64("body").alias("content"), "doc_id", "start", "body")
    leaders = _stored(
        part.groupBy("bucket", "content").agg(F.min(F.struct("doc_id", "start", "body")).alias("first"), F.count("*").alias("n")),
        "piece-firsts",
    )
    same = part.join(leaders.where("n > 1").select("bucket", "content", "first.doc_id", "first.start")
                     .toDF("bucket", "content", "_doc", "_start"), ["bucket", "content"])
    same = same.where("doc_id <> _doc OR start <> _start").select(
        "doc_id", F.col("start").alias("lo"), (F.col("start") + F.length("body")).alias("hi")
    )
    wide = cut_lineage(leaders.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    again_open = _stored(leaders.select("bucket", "first.*").join(wide, "bucket"), "open-pieces")
    columns = ["bucket", "doc_id", "start", "body"]
    refined = bodies.where("NOT piece").select(*columns).unionAll(again_open.where(F.col("n") <= MANY).select(*columns))

    marks = "doc_id long, lo long, hi long"
    cold = refined.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine_rows, marks)
    hot = again_open.where(F.col("n") > MANY).select(*columns).mapInArrow(_strings, "bucket long, doc_id long, start long")
    begins = _stored(
        hot.groupBy("bucket").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"),
        "string-firsts",
    )
    singles = hot.join(begins, "bucket").where(F.struct("doc_id", "start") != F.col("first")).select(
        "doc_id", F.col("start").alias("lo"), (F.col("start") + LENGTH).alias("hi")
    )
    every = again.unionAll(same).unionAll(cold).unionAll(singles).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    return packed.join(every, "doc_id", "left").select("doc_id", "packed", "marks").mapInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary"
    )


def _lo(at):
    return F.shiftright(at, 7).alias("lo")


def _hi(at):
    return (F.shiftright(at, 7) + at.bitwiseAND(127) + LENGTH - 1).alias("hi")


def removal_report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return remove_repeats(documents).select(
        "doc_id", "n_bytes",
        F.expr("aggregate(spans, 0L, (total, s) -> total + s.hi - s.lo)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def _decoded(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [k.as_py().decode("utf-8", "ignore") for k in batch.column("kept")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names)

    return run


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the remaining text; texts of which nothing remains are left out.

    Other columns are kept, ``n_chars`` (where there is one) is counted again. A character that a
    removal cuts in two is lost. Texts that were empty or null before stay as they are, as do rows
    without doc_id.
    """
    doc, new = fresh(documents.columns, "kept_doc"), fresh(documents.columns, "kept_text")
    kept = remove_repeats(documents).where(F.size("spans") > 0).dropDuplicates(["doc_id"]).select("doc_id", "kept")
    kept = kept.mapInArrow(_decoded([doc, new]), f"{doc} long, {new} string")
    joined = documents.join(kept, F.col("doc_id") == F.col(doc), "left").where(F.col(new).isNull() | (F.col(new) != ""))
    changed = {"text": F.coalesce(F.col(new), F.col("text")).alias("text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.coalesce(F.length(new).cast("long"), "n_chars").alias("n_chars")
    return joined.select(*[changed.get(c, F.col(f"`{c}`")) for c in documents.columns])
