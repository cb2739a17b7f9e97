"""Dictionary lookups that stay safe when the dictionary is large or a key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dictionary is broadcast only when its entries and key bytes are proven to be below these.
BROADCAST_ENTRIES = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024

# Beyond that: keys holding more than 1 / HOT_SHARE of the rows are spread over SALTS partitions.
HOT_SHARE = 200
SALTS = 32


def fits_broadcast(entries: int, key_bytes: int) -> bool:
    return entries <= BROADCAST_ENTRIES and key_bytes <= BROADCAST_BYTES


def measure(dictionary: DataFrame, key: str) -> tuple[int, int]:
    """Entries and key bytes of a dictionary (one small aggregate)."""
    row = dictionary.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("b"),
    ).first()
    return row["n"], row["b"]


def hot_keys(df: DataFrame, key: Column, share: int = HOT_SHARE) -> list:
    """Keys above 1/share of the rows: at most ``share`` of them by construction."""
    counts = df.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return [r["k"] for r in counts.where(F.col("n") * share > total).collect()]


def lookup(
    df: DataFrame,
    dictionary: DataFrame,
    key: Column,
    dictionary_key: str,
    value: str,
    size: tuple[int, int] | None = None,
    streaming: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """``df`` plus column ``value`` of the dictionary entry equal to ``key`` (NULL when absent).

    ``size`` is (entries, key bytes) when already known. A small dictionary is broadcast. A large one
    is shuffled with ``df``; rows of hot keys are spread over salted copies of their one entry, so no
    task receives a whole hot key. Missing keys never match and are spread by row as well.
    """
    probe, entry = "__probe", "__entry"
    right = dictionary.select(F.col(dictionary_key).alias(entry), F.col(value))
    left = df.withColumn(probe, key)
    entries, key_bytes = measure(dictionary, dictionary_key) if size is None else size
    if fits_broadcast(entries, key_bytes):
        joined = left.join(F.broadcast(right), F.col(probe) == F.col(entry), "left")
        return joined.drop(probe, entry)
    if streaming:
        # a stream is joined to the static side batch by batch; adaptive execution handles skew there
        return left.join(right, F.col(probe) == F.col(entry), "left").drop(probe, entry)
    hot = hot_keys(df, key)
    # by row content and input partition: a repeated task gives every row the same salt again, and
    # even rows that are equal throughout are spread
    content = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *content), F.lit(salts)).cast("int")
    is_hot = F.col(probe).isNull() | (F.col(probe).isin(hot) if hot else F.lit(False))
    left = left.withColumn("__salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    copies = F.when(
        F.col(entry).isin(hot) if hot else F.lit(False), F.sequence(F.lit(0), F.lit(salts - 1))
    ).otherwise(F.array(F.lit(0)))
    right = right.withColumn("__entry_salt", F.explode(copies))
    joined = left.join(
        right, (F.col(probe) == F.col(entry)) & (F.col("__salt") == F.col("__entry_salt")), "left"
    )
    return joined.drop(probe, entry, "__salt", "__entry_salt")
