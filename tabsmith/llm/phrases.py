"""Phrase collocations: word n-grams of FM-indexed shards, summed over shards and scored exactly.

A shard is about half a million words of one task. Its text, as word ids with a 0 behind every piece, is
sorted in both directions to the depth of the longest phrase, which is all that intervals of phrases up
to that length need. A phrase is an interval of rows in either index; one more word to the right is
found in the backward index (whose transform holds the following word), one more to the left in the
forward index, and each step moves both intervals.

1. Every shard enumerates its words and word pairs with their counts; one aggregate sums them.
2. Pairs of the wanted count are put into a bit table of fixed size, which is broadcast. Every shard
   extends the intervals of its pairs to the left, where the table holds both pairs of a triple; other
   triples cannot reach the count. A wrong bit only lets a triple be counted that is dropped later.
3. Sums below the count go, the rest is joined with its parts and scored.

Words carry their language in their hash, so phrases of two languages never meet.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.text import letters, mix, slices, strings, words
from tabsmith.session import scratch_path

MIN_COUNT, INSIDE_PERCENT, TOP = 10, 50, 2000
SCALE = 1_000_000
SHARD_WORDS = 1 << 19
CHUNK = 1 << 18
OUT_ROWS = 1 << 17
#: Bits of the table of frequent pairs: 8 MB, whatever the corpus.
TABLE_BITS = 26
SALTS = 64

BLANKS, STOPS = b" \t", b".,;:!?\x0a\x0b\x0c\x0d"
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True
_EDGE = _STOP.copy()
_EDGE[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- the index of a shard -----------------------------------------------------------------------


def _order(first: np.ndarray, second: np.ndarray, third: np.ndarray, size: int) -> np.ndarray:
    """Rows by their three words; ids below 2^21 fit one 63-bit key."""
    if size < 1 << 21:
        return np.argsort(((first.astype(np.int64) << 21) + second << 21) + third)
    return np.lexsort((third, second, first))


class Phrases:
    """Intervals of phrases: word columns and the first row in the forward and backward index, with the count."""

    def __init__(self, columns: list[np.ndarray], forward: np.ndarray, backward: np.ndarray | None, count: np.ndarray):
        self.columns, self.forward, self.backward, self.count = columns, forward, backward, count

    def where(self, mask: np.ndarray) -> Phrases:
        backward = None if self.backward is None else self.backward[mask]
        return Phrases([c[mask] for c in self.columns], self.forward[mask], backward, self.count[mask])


class Index:
    """FM-index of word ids in both directions. ``ids`` starts with 0 and has a 0 behind every piece."""

    def __init__(self, ids: np.ndarray, size: int, forward: bool = True):
        self.size, self.n = size, len(ids)
        padded = np.concatenate((np.zeros(2, ids.dtype), ids, np.zeros(2, ids.dtype)))
        at = lambda k: padded[2 + k : 2 + k + self.n]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=size))))
        #: the word before the rows of the forward order, the word behind those of the backward order
        self.before = at(-1)[_order(ids, at(1), at(2), size)] if forward else None
        self.behind = at(1)[_order(ids, at(-1), at(-2), size)]
        self._ranks: dict[bool, np.ndarray] = {}

    def single(self) -> Phrases:
        """All words."""
        word = np.arange(1, self.size, dtype=np.int64)
        return Phrases([word], self.first[word], self.first[word], self.first[word + 1] - self.first[word])

    def _rank(self, right: bool, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``word`` stands in the transform above ``row``."""
        if right not in self._ranks:
            column = (self.behind if right else self.before).astype(np.int64)
            self._ranks[right] = np.sort(column * self.n + np.arange(self.n))
        return np.searchsorted(self._ranks[right], word * self.n + row) - self.first[word]

    def extend(self, phrases: Phrases, right: bool, both: bool = True) -> Phrases:
        """Every phrase with one more word to the right or left, with counts, in order of phrase and word.

        ``both=False`` leaves out the interval that a further step in the same direction would need.
        """
        start = phrases.backward if right else phrases.forward
        other = phrases.forward if right else phrases.backward
        count = phrases.count
        ends = np.cumsum(count)
        owner = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(owner)) + np.repeat(start - (ends - count), count)
        key = np.sort(owner * self.size + (self.behind if right else self.before)[rows])
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        owner, word = np.divmod(key[at], self.size)
        found = np.diff(np.append(at, len(key)))
        moved = None if other is None else other[owner] + at - (ends - count)[owner]
        same = self.first[word] + self._rank(right, word, start[owner]) if both else None
        columns = [c[owner] for c in phrases.columns]
        columns = [*columns, word] if right else [word, *columns]
        out = Phrases(columns, moved if right else same, same if right else moved, found) if both or right else \
            Phrases(columns, np.zeros(len(word), np.int64), moved, found)
        return out.where(word > 0)


# --- shards of a task ---------------------------------------------------------------------------


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of about 256 KB; long texts are cut behind a stop."""
    for lo, hi in slices(offsets, CHUNK):
        a, b = int(offsets[lo]), int(offsets[hi])
        while hi - lo == 1 and b - a > 2 * CHUNK:
            stops = np.flatnonzero(_STOP[data[a + CHUNK : b]])
            if not len(stops):
                break
            cut = a + CHUNK + int(stops[0]) + 1
            yield lo, hi, a, cut
            a = cut
        yield lo, hi, a, b


class Shard:
    """Words of the texts read so far: their keys, where pieces start, and where the text of each stands."""

    def __init__(self, seed: int, keep_text: bool):
        self.letter, self.keep_text = letters(seed), keep_text
        self.hashes: dict[str, np.uint64] = {}
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.n = [], [], 0
        self.text, self.begin, self.length, self.lang, self.size = [], [], [], [], 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        """Texts of one chunk."""
        h, begin, length, bounds = words(data, offsets, _EDGE, self.letter)
        if not len(h):
            return
        for lang in set(langs) - self.hashes.keys():
            self.hashes[lang] = np.uint64(_language_hash(lang))
        doc = np.repeat(np.arange(len(langs)), np.diff(bounds))
        salt = np.array([self.hashes[x] for x in langs], np.uint64)
        key = mix(h + salt[doc] * np.uint64(0x9E3779B97F4A7C15))
        stops = np.cumsum(_STOP[data])[begin]
        start = np.concatenate(([True], (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])))
        if self.keep_text:
            known = list(self.hashes)
            self.text.append(_LOWER[data])
            self.begin.append(begin + self.size)
            self.length.append(length)
            self.lang.append(np.array([known.index(x) for x in langs], np.int32)[doc])
            self.size += len(data)
        self.keys.append(key)
        self.starts.append(start)
        self.n += len(key)

    def index(self, forward: bool) -> tuple[Index, np.ndarray, np.ndarray]:
        """The index, the key of each id (id 0 has none) and a place among the words for every key."""
        keys = np.concatenate(self.keys)
        known, at, ids = np.unique(keys, return_index=True, return_inverse=True)
        start = np.concatenate(self.starts)
        # one 0 before every piece and one behind the last
        place = np.arange(len(ids)) + np.cumsum(start)
        text = np.zeros(len(ids) + int(start.sum()) + 1, np.int32)
        text[place] = ids + 1
        return Index(text, len(known) + 1, forward), np.concatenate((np.zeros(1, np.uint64), known)), at

    def names(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Language and lower-cased text of the words at these places."""
        text, begin, length, lang = (np.concatenate(x) for x in (self.text, self.begin, self.length, self.lang))
        begin, length = begin[at], length[at]
        offsets = np.concatenate(([0], np.cumsum(length)))
        data = text[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], length)]
        word = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        return pa.array(list(self.hashes)).take(pa.array(lang[at])), word.cast(pa.string())


def _shards(batches: Iterator[pa.RecordBatch], seed: int, keep_text: bool) -> Iterator[Shard]:
    shard = Shard(seed, keep_text)
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        langs = ["und" if x is None else x for x in batch.column("lang").to_pylist()]
        for lo, hi, a, b in _chunks(data, offsets):
            shard.add(data[a:b], np.clip(offsets[lo : hi + 1] - a, 0, b - a), langs[lo:hi])
            if shard.n >= SHARD_WORDS:
                yield shard
                shard.clear()
    if shard.n:
        yield shard


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, OUT_ROWS):
        yield batch.slice(at, OUT_ROWS)


def _pairs(seed: int):
    """(a, b, lang, word, n): words (b, the second word, is null) and pairs (lang and word are null)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, seed, True):
            index, key, at = shard.index(False)
            one = index.single()
            columns = [_signed(key[1:]), pa.nulls(len(at), pa.int64()), *shard.names(at), pa.array(one.count)]
            yield from _cut(pa.RecordBatch.from_arrays(columns, schema=schema))
            two = index.extend(one, True, both=False)
            nothing = pa.nulls(len(two.count), pa.string())
            columns = [_signed(key[two.columns[0]]), _signed(key[two.columns[1]]), nothing, nothing, pa.array(two.count)]
            yield from _cut(pa.RecordBatch.from_arrays(columns, schema=schema))

    return run


def _spots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a pair in the table."""
    h = mix(a * np.uint64(0xBF58476D1CE4E5B9) + b)
    bits = np.uint64(TABLE_BITS)
    return h >> (np.uint64(64) - bits), h & np.uint64((1 << TABLE_BITS) - 1)


def _holds(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    one, two = _spots(a, b)
    bit = lambda x: (table[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(one) & bit(two)).astype(bool)


def _pair_table(pairs: DataFrame) -> np.ndarray:
    """The bit table of all pairs: spots are merged in the cluster, at most 2^20 words of 64 bits come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            spot = np.concatenate(_spots(a, b))
            place = (spot >> np.uint64(6)).astype(np.int64)
            value = np.left_shift(np.uint64(1), spot & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(value)], ["place", "value"])

    spots = pairs.select("a", "b").mapInArrow(run, "place long, value long")
    merged = spots.groupBy("place").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[merged.column("place").to_numpy()] = merged.column("value").to_numpy().view(np.uint64)
    return table.view(np.uint8)


def _triples(seed: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, seed, False):
            table = np.frombuffer(shared.value, np.uint8)
            index, key, _ = shard.index(True)
            two = index.extend(index.single(), True, both=False)
            two = two.where(_holds(table, key[two.columns[0]], key[two.columns[1]]))
            three = index.extend(two, False, both=False)
            three = three.where(_holds(table, key[three.columns[0]], key[three.columns[1]]))
            columns = [_signed(key[c]) for c in three.columns]
            yield from _cut(pa.RecordBatch.from_arrays([*columns, pa.array(three.count)], ["a", "b", "c", "n"]))

    return run


# --- the whole corpus ---------------------------------------------------------------------------


def phrase_counts(documents: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of ``documents(text, lang)``: words, pairs and triples of consecutive words of a piece.

    words(lang, word, a, f) holds every word; pairs(a, b, f) and triples(a, b, c, f) those of at least
    ``min_count`` occurrences, by the word keys. Keys are 64-bit hashes of language and word; the tables of
    words are checked, and where two words share a key all is counted again with other hashes. A-Z are
    lower-cased; null text is empty, null lang is ``und``; an empty table gives empty results; repeated rows
    count each time; other columns are not read. Texts of any length are read in chunks that end at a stop.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    for seed in itertools.count(1):
        found = rows.mapInArrow(_pairs(seed), "a long, b long, lang string, word string, n long")
        sums = found.groupBy("a", "b", "lang", "word").agg(F.sum("n").alias("f"))
        path = scratch_path(spark, "phrases")
        sums.where((F.col("f") >= min_count) | F.col("b").isNull()).write.parquet(path)
        stored = spark.read.parquet(path)
        known = stored.where("b IS NULL").select("lang", "word", "a", "f")
        if known.groupBy("a").count().where("count > 1").limit(1).count() == 0:
            break
    pairs = stored.where("b IS NOT NULL").select("a", "b", "f")
    shared = spark.sparkContext.broadcast(_pair_table(pairs).tobytes())
    found = rows.mapInArrow(_triples(seed, shared), "a long, b long, c long, n long")
    path = scratch_path(spark, "phrases")
    found.groupBy("a", "b", "c").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count).write.parquet(path)
    return known, pairs, spark.read.parquet(path)


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers of up to 38 digits."""
    whole = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"({whole(a)} * {whole(a)} * CAST({SCALE} AS DECIMAL(7, 0))) DIV ({whole(left)} * {whole(right)})")


def scored_phrases(words: DataFrame, pairs: DataFrame, triples: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates that no longer candidate holds for the most part.

    ``l`` and ``r`` are the counts of the two parts at the cut of the lowest score, the first on ties.
    """
    def word(name: str, key: str) -> DataFrame:
        """The words under names of their own."""
        return words.select(F.col("a").alias(key), F.col("word").alias(f"w_{name}"), F.col("f").alias(f"f_{name}"), F.col("lang").alias(f"lang_{name}"))

    # one-word extensions to the left and right of a pair
    longer = triples.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "f")
    longer = longer.groupBy("p.a", "p.b").agg(F.max("f").alias("longer"))
    two = pairs.join(longer, ["a", "b"], "left").where(~F.coalesce(100 * F.col("longer") >= inside_percent * F.col("f"), F.lit(False)))
    two = two.join(word("1", "a"), "a").join(word("2", "b"), "b").select(
        F.col("lang_1").alias("lang"), F.concat_ws(" ", "w_1", "w_2").alias("phrase"), F.col("f").alias("a"),
        F.col("f_1").alias("l"), F.col("f_2").alias("r"), _score("f", "f_1", "f_2").alias("score"),
    )
    head = pairs.toDF("a", "b", "f_12")
    tail = pairs.toDF("b", "c", "f_23")
    three = triples.join(head, ["a", "b"]).join(tail, ["b", "c"])
    three = three.join(word("1", "a"), "a").join(word("2", "b"), "b").join(word("3", "c"), "c")
    three = three.withColumns({"s1": _score("f", "f_1", "f_23"), "s2": _score("f", "f_12", "f_3")})
    later = F.col("s2") < F.col("s1")
    pick = lambda x, y: F.when(later, F.col(y)).otherwise(F.col(x))
    three = three.select(
        F.col("lang_1").alias("lang"), F.concat_ws(" ", "w_1", "w_2", "w_3").alias("phrase"), F.col("f").alias("a"),
        pick("f_1", "f_12").alias("l"), pick("f_23", "f_3").alias("r"), pick("s1", "s2").alias("score"),
    )
    return two.unionAll(three)


def collocations(
    documents: DataFrame, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, top: int = TOP
) -> DataFrame:
    """Each language's first ``top`` phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    ``n`` counts all words of the language. Order: score and a falling, then the phrase by its bytes. See
    ``phrase_counts`` for nulls, empty tables, repeated rows and long texts. The ranking keeps ``top`` rows
    of each of 64 parts of a language before it ranks the language, so none is sorted whole in one task.
    """
    known, pairs, triples = phrase_counts(documents, min_count)
    total = known.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = known.where(F.col("f") >= min_count)
    found = scored_phrases(frequent, pairs, triples, inside_percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    found = found.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    found = found.where(F.col("k") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return found.where(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
