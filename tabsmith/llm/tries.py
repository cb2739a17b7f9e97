"""Prefix trie of conversations: blocks of four turns are grouped first, single turns only where blocks diverge.

Every turn of a conversation has a 128-bit identity of its role, text and position; the identity of a
prefix is the exclusive or of its turns, so prefixes of blocks are running values of whole blocks.

1. Conversations are cut into blocks of four turns. Conversations with the same prefix and the same next
   block form a variant, a partial aggregate that a hot group of copies folds into one row per task.
2. A prefix with a single variant gives its turns as nodes without further grouping. Only where a prefix
   has several variants are these (not the conversations) laid out turn by turn and grouped again.
3. Sums over a subtree need no walk of the tree. A conversation represents the nodes whose smallest member
   it is: none, or all from some depth on. The tokens a subtree saves are, over its members, the bytes of
   the turns that the member does not represent, and its leaves are the members that represent one.

A conversation may hold any share of the turns: they are placed by ranges of the sorted table, and running
values are kept per 1024 blocks with offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.session import scratch_path

BLOCK = 4
#: Blocks with one running value, as a power of two.
STRETCH_BITS = 10
#: Conversations in one list of ids, as a power of two.
CHUNK_BITS = 10

_BEFORE = (Window.unboundedPreceding, -1)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``, the place of a row among the rows of its conversation in this (sorted) partition."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        at = np.arange(len(ids)) - np.repeat(head, np.diff(np.append(head, len(ids))))
        if last is not None and ids[0] == last:
            at[: head[1] if len(head) > 1 else len(ids)] += seen
        last, seen = ids[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, bytes) of every turn of ``conversations(conv_id, turn, role, text)``.

    ``pos`` counts from 0 by turn (null first); equal turns are ordered by the digest of role and text, so
    repeated rows are turns of their own. Null role or text is empty. Rows without conv_id are left out.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn_id = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id.alias("turn_id"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_id")]
    path = scratch_path(spark, "turns")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("conv_id", "turn_id", "bytes", F.spark_partition_id().alias("part")).mapInArrow(
        _numbered, "conv_id long, turn_id binary, bytes long, part int, at long"
    ).write.parquet(path)
    stored = spark.read.parquet(path)
    # ranges cut a conversation only at their ends: at most two of them per range
    ends = stored.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    ends = ends.select(F.explode(F.array("lo", "hi")).alias("conv_id")).distinct()
    sizes = stored.join(F.broadcast(ends), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    offsets = sizes.select(
        "conv_id", "part", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*_BEFORE)).alias("offset")
    ).where("offset IS NOT NULL")
    out = stored.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("pos"), "turn_id", "bytes")


def rebuilt_turns(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: (conv_id, length) of all and (conv_id, pos, turn_id, bytes, length) of their turns.

    Conversation c starts with the first h turns of conversation c - c % group (all if fewer, none if it is
    absent), followed by its own turns after its first h; h is crc32 of the decimal c modulo ``heads``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    base = sizes.toDF("base_id", "base_n")
    plan = sizes.withColumns({"h": h, "base_id": F.col("conv_id") - F.col("conv_id") % group}).join(base, "base_id", "left")
    plan = plan.withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = plan.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    path = scratch_path(turns.sparkSession, "plan")
    plan.select("conv_id", "base_id", "h", "shared", "length").write.parquet(path)
    plan = turns.sparkSession.read.parquet(path)
    # only shared openings of another length than h move the rest
    own = turns.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "turn_id", "bytes", "length")
    given = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base_id")
    given = given.select("*", F.explode(F.sequence(F.col("base_id") - (group - 1), F.col("base_id") + (group - 1))).alias("conv_id"))
    given = given.where(F.col("conv_id") - F.col("conv_id") % group == F.col("base_id")).join(plan.drop("base_id"), "conv_id").where("pos < h")
    return plan.select("conv_id", "length"), own.unionAll(given.select("conv_id", "pos", "turn_id", "bytes", "length"))


def _folded(turns: Column, name: str, start: Column) -> Column:
    """start XOR the ``name`` values of ``turns``."""
    return F.aggregate(turns, start, lambda acc, t: acc.bitwiseXOR(t[name]))


def _total(turns: Column, start: Column) -> Column:
    return F.aggregate(turns, start, lambda acc, t: acc + t["bytes"])


def conversation_blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, k, turns, s1, s2, done, last): block k of each conversation behind the prefix (s1, s2) of ``done`` bytes."""
    zero = F.lit(0).cast("long")
    ids = [F.xxhash64(F.lit(i), "turn_id", "pos").alias(f"u{i}") for i in (1, 2)]
    k = F.expr(f"pos DIV {BLOCK}")
    rows = turns.select("conv_id", k.alias("k"), F.shiftright(k, STRETCH_BITS).alias("stretch"), "pos", *ids, "bytes", "length")
    rows = rows.repartition("conv_id", "stretch").groupBy("conv_id", "stretch", "k").agg(
        F.sort_array(F.collect_list(F.struct("pos", "u1", "u2", "bytes"))).alias("turns"), F.max("length").alias("length")
    )
    rows = rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["u1"].alias("u1"), t["u2"].alias("u2"), t["bytes"].alias("bytes"))))
    own = {"x1": _folded(F.col("turns"), "u1", zero), "x2": _folded(F.col("turns"), "u2", zero), "size": _total(F.col("turns"), zero)}
    rows = rows.withColumns(own)
    inside = Window.partitionBy("conv_id", "stretch").orderBy("k").rowsBetween(*_BEFORE)
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(*_BEFORE)
    sums = {"s1": F.bit_xor("x1"), "s2": F.bit_xor("x2"), "done": F.sum("size")}
    # conversations of more than one stretch
    offsets = rows.groupBy("conv_id", "stretch").agg(*[v.alias(f"o_{c}") for c, v in sums.items()])
    long = rows.where("stretch > 0").select("conv_id").distinct()
    offsets = offsets.join(long, "conv_id", "left_semi")
    shifted = {"o_s1": F.bit_xor("o_s1"), "o_s2": F.bit_xor("o_s2"), "o_done": F.sum("o_done")}
    offsets = offsets.withColumns({c: v.over(earlier) for c, v in shifted.items()}).where("stretch > 0")
    rows = rows.withColumns({c: F.coalesce(v.over(inside), zero) for c, v in sums.items()})
    rows = rows.join(offsets, ["conv_id", "stretch"], "left")
    return rows.select(
        "conv_id", "k", "turns", *[F.col(c).bitwiseXOR(F.coalesce(f"o_{c}", zero)).alias(c) for c in ("s1", "s2")],
        (F.col("done") + F.coalesce("o_done", zero)).alias("done"),
        (F.col("k") * BLOCK + F.size("turns") == F.col("length")).alias("last"),
    )


def _nodes(blocks: DataFrame) -> DataFrame:
    """The nodes below the root from ``blocks`` with the columns q and leaf of their conversation.

    depth, y1, y2 (the node), p1, p2 (its parent), bytes, path (bytes up to here), conv_id, n_convs,
    saved and leaves.
    """
    key = ["k", "s1", "s2"]
    turns = F.col("turns")
    # what a conversation keeps back at each turn of its block
    before = [_total(F.slice(turns, 1, i), F.col("done")) if i else F.col("done") for i in range(BLOCK)]
    left = [F.sum(F.greatest(F.col("q") - b, F.lit(0))).alias(f"left{i}") for i, b in enumerate(before)]
    variants = blocks.groupBy(*key, "turns", "done").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("leaves"), *left
    )
    each = [c for c in variants.columns if c not in key]
    single = variants.groupBy(*key).agg(F.count("*").alias("variants"), *[F.min(c).alias(c) for c in each]).where("variants = 1")
    several = variants.join(single.select(*key), key, "left_anti")

    def laid_out(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("i"))
        upto, above = F.slice(turns, 1, F.col("i")), F.slice(turns, 1, F.col("i") - 1)
        return rows.select(
            (F.col("k") * BLOCK + F.col("i")).alias("depth"),
            *[_folded(upto, f"u{j}", F.col(f"s{j}")).alias(f"y{j}") for j in (1, 2)],
            *[_folded(above, f"u{j}", F.col(f"s{j}")).alias(f"p{j}") for j in (1, 2)],
            F.element_at(turns, F.col("i"))["bytes"].alias("bytes"), _total(upto, F.col("done")).alias("path"),
            "conv_id", "n_convs", F.element_at(F.array(*[f"left{i}" for i in range(BLOCK)]), F.col("i")).alias("saved"), "leaves",
        )

    refined = laid_out(several).groupBy("depth", "y1", "y2", "p1", "p2", "bytes", "path").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )
    return laid_out(single).unionByName(refined)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined lists of each node; the rows of a node follow each other in order."""
    last, state, done = None, None, []

    def out():
        columns = list(zip(*done))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["depth", "y1", "y2", "ends_sha256"])

    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "y1", "y2", "ids"))):
            if node == last:
                state.update(b"," + ids.encode())
                continue
            if last is not None:
                done.append((*last, state.hexdigest()))
            last, state = node, hashlib.sha256(ids.encode())
        if len(done) >= 10_000:
            yield out()
            done.clear()
    if last is not None:
        done.append((*last, state.hexdigest()))
        yield out()


def _ends(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, y1, y2, ends_sha256) of the nodes at which conversations end: ids in lists of 1024, hashed in order."""
    turns = F.col("turns")
    ends = blocks.where("last").select(
        "conv_id", (F.col("k") * BLOCK + F.size("turns")).alias("depth"), *[_folded(turns, f"u{j}", F.col(f"s{j}")).alias(f"y{j}") for j in (1, 2)]
    )
    zero = F.lit(0).cast("long")
    ends = ends.unionByName(lengths.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("y1"), zero.alias("y2")))
    lists = ends.groupBy("depth", "y1", "y2", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lists = lists.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
    lists = lists.repartition("depth", "y1", "y2").sortWithinPartitions("depth", "y1", "y2", "chunk")
    return lists.mapInArrow(_digests, "depth long, y1 long, y2 long, ends_sha256 string")


def prefix_trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, pos, turn_id, bytes, length)``; ``lengths`` has all conversations.

    One row per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. A conversation without turns belongs to the root only.
    Without conversations there is no node, not even a root. Positions must be 0 to length - 1.
    """
    spark = turns.sparkSession
    path = scratch_path(spark, "blocks")
    conversation_blocks(turns).write.parquet(path)
    blocks = spark.read.parquet(path)
    zero = F.lit(0).cast("long")
    # the nodes once without sums, for what each conversation represents
    path = scratch_path(spark, "nodes")
    _nodes(blocks.withColumns({"q": zero, "leaf": zero})).select(
        "depth", "y1", "y2", "p1", "p2", "conv_id", (F.col("path") - F.col("bytes")).alias("above")
    ).write.parquet(path)
    first = spark.read.parquet(path)
    children = first.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("y1"), F.col("p2").alias("y2")).agg(F.count("*").alias("n_children"))
    node = ["depth", "y1", "y2"]
    leaves = first.join(children, node, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    represents = first.groupBy("conv_id").agg(F.min_by("above", "depth").alias("above"))
    totals = blocks.where("last").select("conv_id", _total(F.col("turns"), F.col("done")).alias("total"))
    root_id = F.lit(lengths.agg(F.min("conv_id")).first()[0]).cast("long")
    facts = lengths.join(represents, "conv_id", "left").join(totals, "conv_id", "left").join(leaves, "conv_id", "left")
    facts = facts.select(
        "conv_id", F.coalesce("leaf", zero).alias("leaf"),
        F.when(F.col("conv_id") == root_id, zero).otherwise(F.coalesce("above", "total", zero)).alias("q"),
    )
    path = scratch_path(spark, "facts")
    facts.write.parquet(path)
    facts = spark.read.parquet(path)
    found = _nodes(blocks.join(facts, "conv_id"))
    root = facts.agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("q").alias("saved"), F.sum("leaf").alias("leaves")
    ).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in node], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], zero.alias("bytes"), zero.alias("path"), "conv_id", "n_convs", "saved", "leaves")
    parents = first.select(F.col("depth").alias("pd"), F.col("y1").alias("p1"), F.col("y2").alias("p2"), F.col("conv_id").alias("parent_id"))
    out = found.withColumn("pd", F.when(F.col("depth") > 1, F.col("depth") - 1)).join(parents, ["pd", "p1", "p2"], "left")
    out = out.withColumn("parent_conv_id", F.when(F.col("depth") == 1, root_id).otherwise(F.col("parent_id")))
    out = out.select(*found.columns, "parent_conv_id").unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = out.join(children, node, "left").join(_ends(blocks, lengths), node, "left")
    n_children = F.coalesce("n_children", zero)
    # a root without turns below it is its own leaf
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"),
        F.when((F.col("depth") == 0) & (n_children == 0), F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
