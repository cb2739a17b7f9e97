"""Exact token-length histogram: suffix sums answer totals, quantiles and truncated totals."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage

BLOCK = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a .tiktoken file (read on the driver, then shared)."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def _encoding(pattern: str, ranks: tuple):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(*shared.value)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens) of every row, whole texts however long. The vocabulary is broadcast.

    Null and empty texts have none; repeated rows and rows without doc_id each give their row; other
    columns are ignored. An empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast((pattern, tuple(ranks.items())))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(shared), f"doc_id {kind}, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """One row per length that occurs in ``counts(n_tokens, ...)``, with suffix sums over longer ones.

    Columns: n_tokens, n_docs; docs_longer and tokens_longer count documents above the length;
    truncated_total is the number of tokens when every document is cut to the length; docs_total and
    tokens_total cover all; quantile is the share of documents up to the length. Null lengths are
    ignored, an empty table gives an empty result.

    The sums run inside blocks of 1024 lengths; only one row per block is summed in one task, and the
    number of blocks depends on the longest document, not on how many there are.
    """
    # used twice below; one row per length is stored, so that the texts are encoded once
    hist = cut_lineage(counts.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(
        "block", zero(F.sum("bd").over(later)).alias("later_d"), zero(F.sum("bt").over(later)).alias("later_t"),
        F.sum("bd").over(whole).alias("docs_total"), F.sum("bt").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.withColumn("in_d", zero(F.sum("n_docs").over(inside))).withColumn("in_t", zero(F.sum("tokens").over(inside)))
    out = out.join(blocks, "block").select(
        "n_tokens", "n_docs", (F.col("in_d") + F.col("later_d")).alias("docs_longer"),
        (F.col("in_t") + F.col("later_t")).alias("tokens_longer"), "docs_total", "tokens_total",
    )
    return out.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        "docs_total", "tokens_total", ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def truncated_totals(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """(context, total) for every non-null ``limits(context)``: tokens when documents are cut to it.

    A context below or between lengths uses the longest length not above it. Limits may be many: they
    are joined by block, through the last length of earlier blocks where their own has none below.
    """
    marks = limits.select(F.col("context").cast("long").alias("n_tokens")).where("n_tokens IS NOT NULL").distinct()
    rows = histogram.select("n_tokens", "docs_longer", "tokens_longer", "docs_total", "tokens_total", F.lit(0).alias("ask"))
    whole = histogram.select("docs_total", "tokens_total").limit(1)
    asks = marks.select("n_tokens", *[F.lit(None).cast("long").alias(c) for c in rows.columns[1:5]], F.lit(1).alias("ask"))
    rows = rows.unionAll(asks).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    below = Window.partitionBy("block").orderBy("n_tokens", "ask").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("block").agg(F.max_by(F.struct("docs_longer", "tokens_longer"), F.when(F.col("ask") == 0, F.col("n_tokens"))).alias("end"))
    ends = ends.select("block", F.last("end", ignorenulls=True).over(before).alias("earlier"))
    state = F.last(F.when(F.col("ask") == 0, F.struct("docs_longer", "tokens_longer")), ignorenulls=True).over(below)
    placed = rows.withColumn("state", state).where("ask = 1").join(ends, "block").crossJoin(F.broadcast(whole.toDF("d", "t")))
    docs = F.coalesce("state.docs_longer", "earlier.docs_longer", "d")
    tokens = F.coalesce("state.tokens_longer", "earlier.tokens_longer", "t")
    return placed.select(F.col("n_tokens").alias("context"), (F.col("t") - tokens + F.col("n_tokens") * docs).alias("total"))
