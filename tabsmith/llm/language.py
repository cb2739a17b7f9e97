"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as its runs of letters in lower case; a run is scored from a boundary to a boundary, so
equal words have equal scores and each distinct word of a slice is scored once. The models of all
languages lie in one sorted array of n-gram hashes per order, with a column of probabilities per
language. The language with the lowest cross-entropy per character wins; a text whose cross-entropy lies
above the language's calibrated bound is rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.text import mix, slices, stream, strings

ORDER = 4
BOUNDARY = 0x20
#: The models are fitted on about so many labelled documents per language (chosen by hash of doc_id).
TRAINING_DOCS = 4000
#: Bound of the broadcast models.
MODEL_BYTES = 256 << 20
#: A cross-entropy up to this share of the way from the language's own texts to uniform letters is never
#: rejected (texts of two languages lie below it).
ALLOWANCE = 0.6
#: A score never uses more evidence than that of so many characters.
EVIDENCE = 50
UNKNOWN = "und"

_STEP = stream(31, 16) | np.uint64(1)
_PLACE = stream(32, 1024) | np.uint64(1)


@functools.cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case) of every code point; lower cases of several characters are left as they are."""
    every = [chr(c) for c in range(0x110000)]
    letter = np.array([c.isalpha() for c in every])
    low = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        small = every[c].lower()
        if len(small) == 1:
            low[c] = ord(small)
    return letter, low


def letter_words(data: np.ndarray, offsets: np.ndarray):
    """(code points, first letter, length, hash of each word, word range of each document)."""
    letter, low = _alphabet()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ahead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = ahead[offsets]
    solid = letter[codes]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < len(codes)]
    first[heads] = solid[heads]
    begin, pos = np.flatnonzero(first), np.flatnonzero(solid)
    codes = low[codes]
    if not len(begin):
        return codes, begin, begin, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    heads_at = np.searchsorted(pos, begin)
    length = np.diff(np.append(heads_at, len(pos)))
    nth = np.arange(len(pos)) - np.repeat(heads_at, length)
    value = mix(codes[pos].astype(np.uint64)) * _PLACE[nth & 1023]
    return codes, begin, length, mix(np.add.reduceat(value, heads_at) + length.astype(np.uint64)), np.searchsorted(begin, at)


def _padded(codes: np.ndarray, begin: np.ndarray, length: np.ndarray, order: int):
    """Words between boundaries in one array: order - 1 before, one after; and the predicted positions."""
    size = length + order
    base = np.cumsum(size) - size
    line = np.full(int(size.sum()), BOUNDARY, np.uint32)
    nth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    line[np.repeat(base + order - 1, length) + nth] = codes[np.repeat(begin, length) + nth]
    word = np.repeat(np.arange(len(begin)), length + 1)
    step = np.arange(len(word)) - np.repeat(np.cumsum(length + 1) - (length + 1), length + 1)
    return line, base[word] + order - 1 + step, word


def _gram_hash(line: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each position."""
    total = np.full(len(at), n + 1, np.uint64)
    for j in range(n):
        total = total + mix(line[at - j].astype(np.uint64) + np.uint64(1)) * _STEP[j]
    return mix(total)


def _text_hash(grams: list[str], n: int) -> np.ndarray:
    line = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _gram_hash(line, np.arange(len(grams)) * n + n - 1, n) if n else np.full(len(grams), mix(np.full(1, 1, np.uint64))[0])


def _grams(order: int):
    """Counts of the order-long runs of characters per slice and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi in slices(offsets):
                codes, begin, length, h, bounds = letter_words(
                    data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                )
                name, of = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                owner = np.repeat(of, np.diff(bounds))
                for k, lang in enumerate(name):
                    mine = np.flatnonzero(owner == k)
                    if not len(mine):
                        continue
                    _, head, n = np.unique(h[mine], return_index=True, return_counts=True)
                    line, at, word = _padded(codes, begin[mine[head]], length[mine[head]], order)
                    rows = np.stack([line[at - j] for j in range(order - 1, -1, -1)], axis=1)
                    gram = np.ascontiguousarray(rows).view(f"<U{order}").ravel()
                    gram, where = np.unique(gram, return_inverse=True)
                    count = np.bincount(where, weights=n[word]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(lang)] * len(gram)), pa.array(gram.tolist(), pa.string()), pa.array(count)],
                        ["lang", "gram", "n"],
                    )

    return run


@dataclass
class LanguageModel:
    langs: list[str]
    order: int
    floor: float
    keys: list[np.ndarray]  # per order, sorted n-gram hashes
    probability: list[np.ndarray]  # per order, one column per language, NaN where unseen
    context: list[np.ndarray]  # per order, sorted hashes of the contexts
    backoff: list[np.ndarray]  # per order, one column per language, NaN where unseen
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None

    def size(self) -> int:
        return sum(a.nbytes for part in (self.keys, self.probability, self.context, self.backoff) for a in part)

    def word_scores(self, line: np.ndarray, at: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Natural log probability of each of n words under each language."""
        p = np.full((len(at), len(self.langs)), self.floor)
        for k in range(1, self.order + 1):
            context = _gram_hash(line, at - 1, k - 1)
            weight = _found(self.context[k - 1], self.backoff[k - 1], context)
            p = p * np.where(np.isnan(weight), 1.0, weight)
            seen = _found(self.keys[k - 1], self.probability[k - 1], _gram_hash(line, at, k))
            p = np.where(np.isnan(seen), p, seen)
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return np.add.reduceat(np.log(p), cut, axis=0) if n else p

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability per language, scored characters) of each document of a slice."""
        codes, begin, length, h, bounds = letter_words(data, offsets)
        docs = len(offsets) - 1
        total, chars = np.zeros((docs, len(self.langs))), np.zeros(docs, np.int64)
        if not len(h):
            return total, chars
        _, head, of = np.unique(h, return_index=True, return_inverse=True)
        scores = np.concatenate(
            [
                self.word_scores(*_padded(codes, begin[some], length[some], self.order), len(some))
                for some in np.array_split(head, -(-len(head) // 20_000))
            ]
        )
        run = np.zeros((len(h) + 1, len(self.langs)))
        np.cumsum(scores[of], axis=0, out=run[1:])
        ends = np.concatenate([[0], np.cumsum(length + 1)])
        return run[bounds[1:]] - run[bounds[:-1]], ends[bounds[1:]] - ends[bounds[:-1]]


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], np.nan)


def kneser_ney(counts: pd.DataFrame, order: int) -> LanguageModel:
    """Interpolated Kneser-Ney models from (lang, gram, n) counts of the highest order.

    The highest order uses counts, lower ones the number of different characters seen before the gram;
    each order has the discount n1 / (n1 + 2 n2). The uniform floor covers one unseen character.
    """
    langs = sorted(counts["lang"].unique())
    alphabet = {c for g in counts["gram"] for c in g}
    floor = 1.0 / (len(alphabet) + 1)
    per = [[] for _ in range(order)]
    weights = [[] for _ in range(order)]
    for lang in langs:
        own = counts[counts["lang"] == lang]
        tables = {order: own.groupby("gram")["n"].sum()}
        for k in range(order - 1, 0, -1):
            tables[k] = pd.Series(1, index=tables[k + 1].index.str[1:]).groupby(level=0).sum()
        lower = None
        for k in range(1, order + 1):
            t = tables[k]
            n1, n2 = int((t == 1).sum()), int((t == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            head = t.index.str[:-1]
            grouped = t.groupby(head)
            total, kinds = grouped.sum(), grouped.size()
            gamma = d * kinds / total
            below = np.full(len(t), floor) if lower is None else lower.reindex(t.index.str[1:]).to_numpy()
            p = (t.to_numpy() - d) / total.reindex(head).to_numpy() + gamma.reindex(head).to_numpy() * below
            lower = pd.Series(p, index=t.index)
            per[k - 1].append(lower)
            weights[k - 1].append(gamma)

    def merged(columns: list[pd.Series], n: int) -> tuple[np.ndarray, np.ndarray]:
        table = pd.concat(columns, axis=1, keys=range(len(langs)))
        keys = _text_hash(table.index.tolist(), n)
        order_ = np.argsort(keys)
        return keys[order_], table.to_numpy(float)[order_]

    grams = [merged(per[k], k + 1) for k in range(order)]
    contexts = [merged(weights[k], k) for k in range(order)]
    return LanguageModel(
        langs, order, floor, [g[0] for g in grams], [g[1] for g in grams], [c[0] for c in contexts], [c[1] for c in contexts]
    )


def _entropies(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for lo, hi in slices(offsets):
                total, chars = model.value.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                best = total.argmax(axis=1)
                h = -total[np.arange(len(best)), best] / np.maximum(chars, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(lo, hi - lo), pa.array(np.array(model.value.langs)[best].tolist(), pa.string()),
                     pa.array(h), pa.array(chars)],
                    ["lang", "best", "entropy", "chars"],
                )

    return run


def learnable(doc_id) -> F.Column:
    """Rows the contract lets the models learn from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def fit(labelled: DataFrame, order: int = ORDER, training_docs: int = TRAINING_DOCS) -> LanguageModel | None:
    """Models from ``labelled(doc_id, text, lang)``; rows with a null are ignored.

    About ``training_docs`` documents per language are used, chosen by a hash of doc_id; nine tenths
    give the counts, one tenth the calibration of the rejection. Where no row has a letter to learn from, there is no model: None.
    """
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(training_docs / n))])
    sample = rows.where(place < F.element_at(share, F.col("lang")))
    tenth = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(10))
    counts = (
        sample.where(tenth > 0).select("text", "lang").mapInArrow(_grams(order), "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    if counts.empty:  # so few rows that all fell into the calibration share
        counts = rows.select("text", "lang").mapInArrow(_grams(order), "lang string, gram string, n long").groupBy(
            "lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    model = kneser_ney(counts, order)
    if model.size() > MODEL_BYTES:
        raise ValueError("the models exceed their broadcast bound: lower training_docs or order")
    shared = spark.sparkContext.broadcast(model)
    held = sample.where(tenth == 0).select("text", "lang").mapInArrow(
        _entropies(shared), "lang string, best string, entropy double, chars long"
    ).where("chars > 0 AND lang = best").toPandas()
    overall = held["entropy"].mean() if len(held) else np.inf
    centre, spread = [], []
    for lang in model.langs:
        own = held[held["lang"] == lang]
        middle = own["entropy"].mean() if len(own) >= 20 else overall
        centre.append(middle)
        wide = (own["entropy"] - middle).abs() * np.sqrt(own["chars"]) if len(own) >= 20 else pd.Series([0.0])
        spread.append(float(wide.max()))
    model.centre, model.spread = np.array(centre), np.array(spread)
    return model


def _judge(m: LanguageModel, column: pa.Array, tolerance: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, language number, score, cross-entropy, rejected) of each slice of a text column."""
    data, offsets = strings(column)
    for lo, hi in slices(offsets):
        total, chars = m.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        h = -total / np.maximum(chars, 1)[:, None]
        best = h.argmin(axis=1)
        low = h[np.arange(len(best)), best]
        gap = (h - low[:, None]) * np.minimum(chars, EVIDENCE)[:, None]
        share = 1.0 / np.exp(-gap).sum(axis=1)
        none = chars == 0
        limit = m.centre[best] + tolerance * m.spread[best] / np.sqrt(np.maximum(chars, 1))
        limit = np.maximum(limit, m.centre[best] + ALLOWANCE * (-np.log(m.floor) - m.centre[best]))
        best = np.where(none, len(m.langs), best)
        yield lo, hi, best, np.where(none, 0.0, share), np.where(none, np.nan, low), none | (low > limit)


def _predict(model, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.value.langs, UNKNOWN], object)
        for batch in batches:
            for lo, hi, best, share, low, rejected in _judge(model.value, batch.column("text"), tolerance):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(names[best].tolist(), pa.string()), pa.array(share),
                     pa.array(low, from_pandas=True), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return run


def _accepted(model, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, *_, rejected in _judge(model.value, batch.column("text"), tolerance):
                yield batch.slice(lo, hi - lo).filter(pa.array(~rejected))

    return run


def identify(documents: DataFrame, model: LanguageModel | None, tolerance: float = 1.5) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for every row of ``documents(doc_id, text, ...)``.

    ``score`` is the winner's share of the probability of (at most 50 characters of) evidence. Null and
    empty text and text without a letter are ``und`` with score 0, rejected. Ties go to the first
    language by name. Repeated rows give repeated results; a null doc_id is passed on; other columns,
    ``lang`` too, are ignored. ``tolerance`` multiplies the largest deviation seen in calibration.
    Without a model every text is ``und`` with score 0, rejected.
    """
    if model is None:
        return documents.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"),
        )
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _predict(shared, tolerance), f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"
    )


def language_report(documents: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those that ``learnable`` names; see ``identify``.

    An empty table gives an empty result; where nothing can be learned, every text is ``und``.
    """
    model = fit(documents.where(learnable(F.col("doc_id"))))
    return identify(documents, model).select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


def keep_identified(documents: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """``documents`` without the rows whose language is rejected; all columns are kept as they are.

    Where nothing can be learned (no rows, no labels, no letters) nothing can be rejected: every row stays.
    """
    model = fit(documents.where(learnable(F.col("doc_id"))))
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_accepted(shared, tolerance), documents.schema)
