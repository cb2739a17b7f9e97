"""Katz backoff language model over a whole corpus, and the score of every text under it.

P(w | v) = d(c) c(v, w) / (c(v) + 1) where the pair was seen, else alpha(v) P(w), which falls back to the
word's own discounted share and last to the share of the unknown word. d(c) are Good-Turing discounts for
counts up to 5, one count of every context is reserved for what it was not seen with, and alpha(v) makes
the probabilities after v sum to one exactly. Unknown words are one type.

Work is dealt in packed arrays, not rows: a batch is some millions of tokens of one input partition.

1. Each batch sends its different words with their counts to the part of the word; the part sums them and
   answers with an id (small for frequent words) and the total count.
2. Each batch turns its tokens into ids, scores the base model and sends its (context, word, document)
   triples to the part of the context. Contexts above a share of all tokens are dealt by pair instead.
3. Each part sums the pairs, stores its share of the model and the sums of seen pairs per document, with
   the number of seen pairs of each discounted count. Unseen pairs wait for the discounts, which depend
   on all parts; so do the sums of the contexts that several parts share.
4. With the discounts known, the open pairs are scored and everything is summed per document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.text import mix, slices, stream, strings, words
from tabsmith.session import scratch_path

LEARNED = 5  # counts up to this are discounted
BATCH_TOKENS = 1_200_000
END = stream(51, 1)[0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one string: narrowest whole-number type, bytes of equal weight together, compressed."""
    squeeze, out = zstandard.ZstdCompressor(level=3), []
    for a in arrays:
        if a.dtype != np.float64:
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.min_scalar_type(max(top, 0)))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((1, 0), np.uint8)
        body = squeeze.compress(planes.tobytes())
        out.append(struct.pack("<4sqq", a.dtype.str.encode().ljust(4), len(a), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<4sqq", data, at)
        at += struct.calcsize("<4sqq")
        dtype = np.dtype(kind.decode().strip())
        raw = np.frombuffer(zstandard.decompress(data[at : at + size]), np.uint8)
        a = np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.zeros(0, dtype)
        out.append(a if a.dtype == np.float64 else a.astype(np.int64 if a.dtype != np.uint64 else np.uint64))
        at += size
    return out


@dataclass
class _Batch:
    number: int
    docs: np.ndarray
    train: np.ndarray
    sizes: np.ndarray  # tokens of each document, its end included
    words: np.ndarray  # different word hashes, by part and hash
    tokens: np.ndarray  # places in words

    def digest(self) -> int:
        """A number that tells different sets of words apart."""
        return int(mix(self.words).sum(dtype=np.uint64) >> np.uint64(1))


def _token_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[_Batch]:
    first = TaskContext.get().partitionId() << 24
    number, held, n = 0, [], 0

    def made() -> _Batch:
        docs, train, sizes, h = (np.concatenate(x) for x in zip(*held, strict=True))
        different, place = np.unique(h, return_inverse=True)
        order = np.argsort(different % np.uint64(parts), kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        return _Batch(first + number, docs, train, sizes, different[order], where[place])

    for batch in batches:
        data, offsets = strings(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        train = batch.column("train").to_numpy(zero_copy_only=False)
        for lo, hi in slices(offsets):
            h, _, _, bounds = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            held.append((ids[lo:hi], train[lo:hi], np.diff(bounds) + 1, np.insert(h, bounds[1:], END)))
            n += len(held[-1][3])
            if n >= BATCH_TOKENS:
                yield made()
                number, held, n = number + 1, [], 0
    if held:
        yield made()


def _requests(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _token_batches(batches, parts):
            weight = np.repeat(b.train, b.sizes)
            count = np.bincount(b.tokens[weight], minlength=len(b.words))
            cut = np.searchsorted(b.words % np.uint64(parts), np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cut))
            body = []
            for p in some:
                own = b.words[cut[p] : cut[p + 1]]
                body.append(pack(np.diff(own, prepend=np.uint64(0)), count[cut[p] : cut[p + 1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), b.number, np.int64)),
                 pa.array(np.full(len(some), b.digest(), np.int64)), pa.array(body, pa.binary())],
                ["part", "batch", "digest", "body"],
            )

    return run


_REPLY = "part int, batch long, digest long, body binary, types long, tokens long, seen array<long>, ends long"


def _vocabulary(parts: int):
    """Ids and counts of the words of one part for each batch that asked, and the part's statistics."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        asked = [unpack(x) for x in table.column("body").to_pylist()]
        hashes = [np.cumsum(a[0].astype(np.uint64), dtype=np.uint64) for a in asked]
        every, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([a[1] for a in asked])).astype(np.int64)
        rank = np.empty(len(every), np.int64)
        rank[np.lexsort((every, -total))] = np.arange(len(every))
        ids, rows, at = rank * parts + part, [], 0
        for number, digest, h in zip(table.column("batch").to_pylist(), table.column("digest").to_pylist(), hashes, strict=True):
            mine = place[at : at + len(h)]
            at += len(h)
            rows.append((part, number, digest, pack(ids[mine], total[mine]), None, None, None, None))
        end = total[every == END]
        seen = np.bincount(total[total <= LEARNED + 1], minlength=LEARNED + 2)[1:]
        rows.append((part, -1, None, None, int((total > 0).sum()), int(total.sum()), seen.tolist(), int(end.sum())))
        names = ["part", "batch", "digest", "body", "types", "tokens", "seen", "ends"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def discounts(seen: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 0 to 5 (0 unused) from the numbers of types seen 1 to 6 times.

    Where the estimate is no number between 0 and 1 the count is not discounted.
    """
    out = np.ones(LEARNED + 1)
    n = [0, *seen]
    if n[1]:
        limit = (LEARNED + 1) * n[LEARNED + 1] / n[1]
        for r in range(1, LEARNED + 1):
            if n[r] and limit < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - limit) / (1 - limit)
                if 0 < d < 1:
                    out[r] = d
    return out


@dataclass
class Unigrams:
    tokens: int
    types: int
    docs: int
    discount: np.ndarray
    unknown: float

    @staticmethod
    def of(types: int, tokens: int, seen: list[int], docs: int) -> Unigrams:
        d = discounts(seen)
        low = sum(r * n for r, n in enumerate(seen[:LEARNED], 1))
        kept = tokens - low + sum(d[r] * r * seen[r - 1] for r in range(1, LEARNED + 1))
        return Unigrams(tokens, types, docs, d, 1 - kept / (tokens + 1))

    def share(self, count: np.ndarray) -> np.ndarray:
        d = np.where(count <= LEARNED, self.discount[np.minimum(count, LEARNED)], 1.0)
        return np.where(count > 0, d * count / (self.tokens + 1), self.unknown)


def _token_rows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _token_batches(batches, parts):
            body = pack(b.docs.view(np.uint64), b.train.astype(np.uint8), b.sizes, b.tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.number]), pa.array([b.digest()]), pa.array([body], pa.binary())], ["batch", "digest", "body"]
            )

    return run


_PAIRS = "part int, batch long, body binary"


def _pairs(parts: int, u: Unigrams, hot: float):
    """Triples of a batch per part of the context; its documents with their base scores go to parts above."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("the input was read in another order the second time: write it to a table first")
        number = key[0].as_py()
        docs, train, sizes, tokens = unpack(left.column("body")[0].as_py())
        if left.num_rows != 1 or set(right.column("digest").to_pylist()) != {left.column("digest")[0].as_py()}:
            raise RuntimeError("the input was read in another order the second time: write it to a table first")
        answers = [unpack(x) for _, x in sorted(zip(right.column("part").to_pylist(), right.column("body").to_pylist(), strict=True))]
        ids, counts = (np.concatenate([a[i] for a in answers]) for i in (0, 1))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        word, count = ids[tokens] + 1, counts[tokens]
        logs = np.log10((count + 1) / (u.tokens + u.types + 1))
        base = np.add.reduceat(logs, begin)
        known = np.add.reduceat((count > 0).astype(np.int64), begin)
        context, above = np.roll(word, 1), np.roll(count, 1)
        context[begin], above[begin] = 0, u.docs
        spread = np.where(above > hot, mix(context.astype(np.uint64) * np.uint64(0x9E3779B9) + word.astype(np.uint64)), mix(context.astype(np.uint64)))
        part = (spread % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((owner, word, context, part))
        columns = [x[order] for x in (part, context, word, owner)]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(order)))
        part, context, word, owner = (c[at] for c in columns)
        count, above = count[order][at], above[order][at]
        cut = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        body = []
        for p in some:
            s = slice(cut[p], cut[p + 1])
            body.append(pack(np.diff(context[s], prepend=0), word[s], count[s], above[s], owner[s], times[s] * 2 + train[owner[s]]))
        body.append(pack(docs.astype(np.uint64), train, sizes, known, -base))
        some = np.append(some, parts + number % parts)
        return pa.table(
            [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), number, np.int64)), pa.array(body, pa.binary())],
            names=["part", "batch", "body"],
        )

    return run


_FOUND = "kind string, part int, batch long, body binary, seen array<long>"


def _by_document(rows: list, part: int, batch: np.ndarray, doc: np.ndarray, log: np.ndarray, times: np.ndarray, count: np.ndarray) -> None:
    """Adds a row of sums per batch: documents, -log10 of the seen part, seen pairs per discounted count."""
    for number in np.unique(batch):
        mine = np.flatnonzero(batch == number)
        docs, place = np.unique(doc[mine], return_inverse=True)
        sums = [np.bincount(place, weights=-log[mine])]
        low = [np.bincount(place, weights=times[mine] * (count[mine] == r)).astype(np.int64) for r in range(1, LEARNED + 1)]
        rows.append(("sums", part, int(number), pack(docs, *sums, *low), None))


def _contexts(context: np.ndarray, above: np.ndarray, total: np.ndarray, share: np.ndarray):
    """Per context (sorted input): its id, count, undiscounted sum, types of each low count, lower-order share."""
    heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    seen = total > 0
    columns = [np.where(total > LEARNED, total, 0), *[(total == r).astype(np.int64) for r in range(1, LEARNED + 1)]]
    sums = [np.add.reduceat(c, heads) for c in columns]
    return heads, context[heads], above[heads], sums[0], sums[1:], np.add.reduceat(np.where(seen, share, 0.0), heads)


def _count_pairs(parts: int, u: Unigrams, hot: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, rows = key[0].as_py(), []
        if part >= parts:
            rows = [("docs", part, n, body, None) for n, body in zip(table.column("batch").to_pylist(), table.column("body").to_pylist(), strict=True)]
        else:
            got = [unpack(x) for x in table.column("body").to_pylist()]
            sizes = [len(g[0]) for g in got]
            batch = np.repeat(np.array(table.column("batch").to_pylist(), np.int64), sizes)
            context = np.concatenate([np.cumsum(g[0]) for g in got])
            word, count, above, doc, times = (np.concatenate([g[i] for g in got]) for i in range(1, 6))
            del got
            order = np.lexsort((word, context))
            context, word, count, above, doc, times, batch = (x[order] for x in (context, word, count, above, doc, times, batch))
            train, times = times & 1, times >> 1
            new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
            heads = np.flatnonzero(new)
            total = np.add.reduceat(times * train, heads)
            kind = np.cumsum(new) - 1
            share = u.share(count)
            at = total > 0
            rows.append(("model", part, -1, pack(context[heads][at], word[heads][at], total[at]), None))
            rows.append(("seen", part, -1, None, np.bincount(total[at & (total <= LEARNED + 1)], minlength=LEARNED + 2)[1:].tolist()))
            found = total[kind]
            low = np.where(found > 0, np.log10(np.maximum(found, 1) / (above + 1)), np.log10(share)) * times
            # a context never seen in training passes the word on unchanged
            ready = (found > 0) | (above == 0)
            r = np.flatnonzero(ready)
            _by_document(rows, part, batch[r], doc[r], low[r], times[r], found[r])
            c_heads, c_id, c_above, c_sum, c_low, c_share = _contexts(context[heads], above[heads], total, share[heads])
            of = np.repeat(np.arange(len(c_heads)), np.diff(np.append(c_heads, len(heads))))[kind]
            wide = np.flatnonzero(c_above > hot)
            if len(wide):
                rows.append(("wide", part, -1, pack(c_id[wide], c_above[wide], c_sum[wide], *[x[wide] for x in c_low], c_share[wide]), None))
            o = np.flatnonzero(~ready)
            if len(o):
                used, place = np.unique(of[o], return_inverse=True)
                rows.append(("open", part, -1, pack(
                    batch[o], doc[o], place, times[o], -low[o], c_id[used], c_above[used], c_sum[used], *[x[used] for x in c_low], c_share[used],
                ), None))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        names = ["kind", "part", "batch", "body", "seen"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def backoff_weight(discount: np.ndarray, above, undiscounted, low, share):
    """alpha of contexts: what seen words leave, over what the lower order gives unseen ones."""
    used = undiscounted + sum(discount[r] * r * low[r - 1] for r in range(1, LEARNED + 1))
    return (1 - used / (above + 1)) / (1 - share)


def _wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column("body").to_pylist():
            c, above, total, *low, share = unpack(body)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, above, total, *low, share)], _WIDE)


_WIDE = ["context", "above", "total", *[f"low{r}" for r in range(1, LEARNED + 1)], "share"]


def _score_open(discount: np.ndarray, wide: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist(), strict=True):
                number, doc, place, times, log, c, above, total, *low, share = unpack(body)
                alpha = backoff_weight(discount, above, total, low, share)
                alpha = np.array([wide.get(int(i), a) for i, a in zip(c, alpha, strict=True)])
                rows: list = []
                _by_document(rows, part, number, doc, -log + times * np.log10(alpha)[place], times, np.zeros(len(doc), np.int64))
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "part", "batch", "body", "seen"]
                )

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(discount: np.ndarray, tokens: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        docs, train, sizes, known, base = next(unpack(b) for k, b in zip(kinds, bodies, strict=True) if k == "docs")
        score = np.zeros(len(docs))
        for k, b in zip(kinds, bodies, strict=True):
            if k == "sums":
                doc, log, *low = unpack(b)
                score[doc] += -log + sum(np.log10(discount[r]) * low[r - 1] for r in range(1, LEARNED + 1))
        columns = [
            pa.array(docs.view(np.int64)), pa.array(train == 0), pa.array(sizes), pa.array(known),
            pa.array(np.full(len(docs), tokens, np.int64)), pa.array(-base), pa.array(score),
        ]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def learnable(doc_id) -> F.Column:
    """Documents the contract lets the model learn from: crc32 of the id as text, mod 7, is not 2."""
    return F.crc32(doc_id.cast("string")) % 7 != 2


@dataclass
class KatzModel:
    """Where the parts of a fitted model lie, and its global numbers."""

    path: str
    unigrams: Unigrams
    discount: np.ndarray


def fit_and_score(documents: DataFrame) -> tuple[KatzModel, DataFrame]:
    """The model learned from the learnable rows of ``documents(doc_id, text, ...)`` and all scores.

    Tokens are the words (A-Z as a-z) and one end per text; null text is empty and has the end alone.
    Score columns: doc_id, held_out, n_tokens, n_known (seen in training), train_tokens, base_score
    (add-one unigrams) and score, both log10 of the text's probability. Repeated rows are documents of
    their own; rows without doc_id and other columns are ignored. Without a learnable row every token is
    unknown; an empty table gives an empty result.

    The input is read twice and must come in the same order both times, as files do.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id IS NOT NULL").withColumn("train", learnable(F.col("doc_id")))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    replies = scratch_path(spark, "vocabulary")
    asked = docs.mapInArrow(_requests(parts), "part int, batch long, digest long, body binary")
    asked.groupBy("part").applyInArrow(_vocabulary(parts), _REPLY).write.parquet(replies)
    replies = spark.read.parquet(replies)
    sums = replies.where("batch = -1").agg(
        F.sum("types"), F.sum("tokens"), F.sum("ends"), *[F.sum(F.get("seen", F.lit(i))) for i in range(LEARNED + 1)]
    ).first()
    types, tokens, ends, *seen = (int(x or 0) for x in sums)
    u = Unigrams.of(types, tokens, seen, ends)
    hot = tokens / max(1000, 4 * parts)  # so there are at most that many wide contexts

    rows = docs.mapInArrow(_token_rows(parts), "batch long, digest long, body binary")
    told = replies.where("batch >= 0").select("batch", "part", "digest", "body")
    pairs = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_pairs(parts, u, hot), _PAIRS)
    path = scratch_path(spark, "katz")
    pairs.groupBy("part").applyInArrow(_count_pairs(parts, u, hot), _FOUND).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(_FOUND).parquet(path)
    seen = found.where("kind = 'seen'").agg(*[F.sum(F.get("seen", F.lit(i))) for i in range(LEARNED + 1)]).first()
    discount = discounts([int(x or 0) for x in seen])
    wide = found.where("kind = 'wide'").select("body").mapInArrow(
        _wide_rows, ", ".join(f"{c} {'double' if c == 'share' else 'long'}" for c in _WIDE)
    ).groupBy("context").agg(F.max("above").alias("above"), *[F.sum(c).alias(c) for c in _WIDE[2:]])
    weights = {}
    for r in wide.collect():  # bounded: each holds more than a fixed share of all tokens
        low = [r[f"low{k}"] for k in range(1, LEARNED + 1)]
        weights[r["context"]] = float(backoff_weight(discount, r["above"], r["total"], low, r["share"]))
    opened = found.where("kind = 'open'").select("part", "body").mapInArrow(_score_open(discount, weights), _FOUND)
    ready = found.where("kind IN ('docs', 'sums')").select("batch", "kind", "body").unionAll(opened.select("batch", "kind", "body"))
    scores = ready.groupBy("batch").applyInArrow(_finish(discount, tokens), _SCORES)
    return KatzModel(path, u, discount), scores
