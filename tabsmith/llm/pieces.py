"""Encoding and decoding with a SentencePiece vocabulary: an Aho-Corasick automaton drives a Viterbi.

The automaton reads a text once; at every position its output links name all pieces that end there, and
each relaxes the best score of that position. Scores are those of the vocabulary, ties go to the longer
last piece. A character that no piece covers is written as its UTF-8 byte pieces.

Pieces with the word mark inside do not exist in such vocabularies (marks only lead), nor longer pieces
with a line break, so a text splits before every run of marks and around line breaks into chunks that
are encoded on their own; a task encodes each different chunk once. Both properties are checked; for a
vocabulary without them the whole text is one chunk.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Penalty below the lowest score for a character without a piece, per byte.
UNKNOWN_PENALTY = 10.0
#: Chunks a task remembers; the memory is emptied when it is full.
REMEMBERED = 500_000

_CHUNK = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, scores and kinds (normal, byte, control) in the order of their ids."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes_: tuple[int, ...]  # id of each of the 256 byte pieces, or empty
    unknown: int
    normal: tuple[bool, ...]
    prefix: bool = True  # a mark is put before the text

    def leads_only(self) -> bool:
        """Whether a text may be cut before runs of marks and around line breaks."""
        inside = (p for p, n in zip(self.pieces, self.normal, strict=True) if n)
        return all(MARK not in p.lstrip(MARK) and (p == "\n" or "\n" not in p) for p in inside)


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a .model file (read on the driver, then shared)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    by_byte = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    table = tuple(by_byte[f"<0x{b:02X}>"] for b in range(256)) if len(by_byte) == 256 else ()
    normal = tuple(not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids)
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), table, model.unk_id(), normal
    )


@dataclass
class Encoder:
    vocabulary: Vocabulary
    memory: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.automaton = ahocorasick.Automaton()
        for i, (piece, normal) in enumerate(zip(v.pieces, v.normal, strict=True)):
            if normal and piece:
                self.automaton.add_word(piece, (i, len(piece), v.scores[i]))
        self.automaton.make_automaton()
        scores = [s for s, n in zip(v.scores, v.normal, strict=True) if n]
        self.low = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.cut = v.leads_only()
        self.surface = [p.replace(MARK, " ").encode() if n else b"" for p, n in zip(v.pieces, v.normal, strict=True)]
        for b, i in enumerate(v.bytes_):
            self.surface[i] = bytes([b])

    def viterbi(self, chunk: str) -> tuple[int, ...]:
        """Best piece ids of one chunk."""
        n, low = len(chunk), self.low
        best = [0.0] + [float("-inf")] * n
        piece, size_of = [-1] * (n + 1), [1] * (n + 1)
        reached = 0  # positions up to here have been offered the byte pieces of their last character
        for stop, (i, size, score) in self.automaton.iter(chunk):
            while reached < stop:
                reached += 1
                fallback = best[reached - 1] + low * len(chunk[reached - 1].encode())
                if fallback > best[reached]:
                    best[reached], piece[reached], size_of[reached] = fallback, -1, 1
            stop += 1
            score += best[stop - size]
            if score > best[stop]:
                best[stop], piece[stop], size_of[stop] = score, i, size
        while reached < n:
            reached += 1
            fallback = best[reached - 1] + low * len(chunk[reached - 1].encode())
            if fallback > best[reached]:
                best[reached], piece[reached], size_of[reached] = fallback, -1, 1
        out: list[int] = []
        v = self.vocabulary
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            elif v.bytes_:
                out.extend(v.bytes_[b] for b in reversed(chunk[n - 1].encode()))
            else:
                out.append(v.unknown)
            n -= size_of[n]
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the empty text has none."""
        if not text:
            return []
        if self.vocabulary.prefix:
            text = " " + text
        chunks = self.chunks(text)
        found = list(map(self.memory.get, chunks))
        if None in found:
            found = [self.remembered(c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return list(chain.from_iterable(found))

    def chunks(self, text: str) -> list[str]:
        if not self.cut:
            return [text.replace(" ", MARK)]
        if "  " in text or "\0" in text or MARK in text:
            return _CHUNK.findall(text.replace(" ", MARK))
        return text.replace(" ", "\0" + MARK).replace("\n", "\0\n\0").split("\0")

    def remembered(self, chunk: str) -> tuple[int, ...]:
        ids = self.memory.get(chunk)
        if ids is None:
            ids = self.viterbi(chunk)
            if len(chunk) <= 64:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[chunk] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control and unknown pieces have no text."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, exact = [], []
                for text in part.column("text").to_pylist():
                    found = None if text is None else encoder.encode(text)
                    ids.append(None if found is None else np.array(found, np.int32))
                    exact.append(None if found is None else encoder.decode(found) == text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())],
                    ["doc_id", "pieces", "round_trip"],
                )

    return run


def encode(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, pieces, round_trip) for every row of ``documents(doc_id, text, ...)``.

    ``pieces`` are the ids of the best segmentation of the whole text, ``round_trip`` says whether
    decoding gives the text back (a vocabulary without byte pieces may lose characters; a text that
    holds the word mark itself comes back with a blank). Null text has null results, the empty text no
    pieces. Repeated rows give repeated results; a null doc_id is passed on; other columns are ignored.
    The vocabulary (tens of thousands of pieces) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(shared), f"doc_id {kind}, pieces array<int>, round_trip boolean")


def _decode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            text = [None if ids is None else encoder.decode(ids) for ids in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, pieces, ...)``; null pieces give null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "pieces").mapInArrow(_decode(shared), f"doc_id {kind}, text string")
