"""The prefix trie of conversations: which openings conversations share, and what sharing them saves.

Turns become digests at once; from there on a conversation is an array of 128-bit digests and byte counts, and equal
conversations are one row. Rows are dealt by the digest of their first turn. A first-turn subtrie that is too large for a task is
dealt again by the next turn, and so on, until every part fits (equal rows are one, so parts always come apart); the nodes that
were taken apart are summed up from their parts afterwards. Parts are built as dictionary tries inside applyInPandas, several
to a task, and worked off in postorder without recursion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Turns of a subtrie beyond which it is dealt by its next turn (a turn is about half a KB in a task), and ids of a block of
#: those that are hashed together.
PART_TURNS = 200_000
BLOCK_IDS = 10_000
EMPTY_SHA256 = hashlib.sha256().hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, above string"


def turn_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): digests of (role, text) and bytes of text of each conversation's turns, in order.

    Order: turn with null first, then role, then text, so that repeated turns have a place. Null role and text are empty.
    Rows without a conv_id belong to no conversation. One conversation is one array, of about 40 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    known = turns.where("conv_id is not null")

    def listed(of: DataFrame, *ties: Column) -> DataFrame:
        turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("t"), *ties, digest.alias("d"), F.octet_length(text).cast("long").alias("n"))
        return of.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("a"))

    # Only conversations that repeat a turn number are read again with their texts, which then decide.
    repeats = F.size(F.array_distinct("a.t")) < F.size("a")
    plain = cut(listed(known))
    again = listed(known.join(plain.where(repeats).select("conv_id"), "conv_id", "left_semi"), role.alias("r"), text.alias("x"))
    return plain.where(~repeats).select("conv_id", F.col("a.d").alias("seq"), F.col("a.n").alias("sizes")).unionByName(again.select("conv_id", F.col("a.d").alias("seq"), F.col("a.n").alias("sizes")))


def rebuilt(conversations: DataFrame, family: int = 5, folds: int = 9) -> DataFrame:
    """(conv_id, seq, sizes) with the opening of each conversation's family head: c's first h turns are those of c - c % family, h =
    crc32 of c's digits modulo folds; its own turns follow after its first h. % truncates, as in SQL."""
    arrays = cut(conversations)
    head = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % folds).cast("int")
    heads = arrays.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.slice("seq", 1, folds - 1).alias("head_seq"), F.slice("sizes", 1, folds - 1).alias("head_sizes"))
    joined = arrays.withColumn("head", head).withColumn("h", h).join(heads, "head", "left")

    def spliced(own: str, other: str) -> Column:
        return F.concat(F.slice(F.coalesce(F.col(other), F.slice(own, 1, 0)), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.size(own))).alias(own)

    return joined.select("conv_id", spliced("seq", "head_seq"), spliced("sizes", "head_sizes"))


def _ends(rows: DataFrame) -> DataFrame:
    """(first, ends_sha256) of each distinct sequence: SHA-256 of its conv_ids, ascending and comma-joined.

    A range-partitioned sort splits even a sequence that most conversations have; partitions join up blocks of ids, and what
    meets in one task is a row for each block.
    """

    def rows_of(done: list[tuple[str, int, str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["whole", "first", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, done = None, [], []
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) == BLOCK_IDS):
                    done.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(i)
            yield rows_of(done)
            done = []
        if ids:
            yield rows_of([(key, ids[0], ",".join(map(str, ids)))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sha = None, None, None
        for batch in batches:
            done = []
            for k, i, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    done.append((first, sha.hexdigest()))
                key, first, sha = k, i, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["first", "ends_sha256"])
        if sha:
            yield pa.record_batch([pa.array([first], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["first", "ends_sha256"])

    joined = rows.repartitionByRange("whole", "conv_id").sortWithinPartitions("whole", "conv_id").mapInArrow(blocks, "whole string, first long, ids string")
    return joined.repartition("whole").sortWithinPartitions("whole", "first").mapInArrow(hashed, "first long, ends_sha256 string")


def build(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of all subtries of a task: a dictionary of children for each node, and sums in postorder without recursion.

    A row is a distinct sequence; its subtrie's top is the node of its first `depth` turns. Nodes are numbered as they are made, so
    children have larger numbers than their parents, and going backwards is a postorder.
    """
    first, depth, size, n, parent, ends, children, above = [], [], [], [], [], [], [], []
    up: list[int | None] = []
    tops: dict[str, int] = {}

    def make(d: int, bytes_: int, i: int, of: int | None) -> int:
        for column, value in ((first, i), (depth, d), (size, bytes_), (n, 0), (parent, of), (ends, EMPTY_SHA256), (children, None), (above, None), (up, None)):
            column.append(value)
        return len(first) - 1

    for row in frame.sort_values("first").itertuples(index=False):  # so a node's first member is its smallest
        node = tops.get(row.key)
        if node is None:
            node = tops[row.key] = make(row.depth, int(row.sizes[row.depth - 1]), row.first, None)
            above[node], up[node] = row.above, int(row.up)
        n[node] += row.n
        for k in range(row.depth, len(row.seq)):
            links = children[node]
            if links is None:
                links = children[node] = {}
            digest = row.seq[k]
            child = links.get(digest)
            if child is None:
                child = links[digest] = make(k + 1, int(row.sizes[k]), row.first, node)
            node = child
            n[node] += row.n
        ends[node] = row.ends_sha256
    leaves = [0 if c else 1 for c in children]
    saved = [(m - 1) * b for m, b in zip(n, size, strict=True)]
    for node in range(len(first) - 1, -1, -1):
        if (of := parent[node]) is not None:
            leaves[of] += leaves[node]
            saved[of] += saved[node]
    return pd.DataFrame({
        "conv_id": first, "depth": depth, "parent_conv_id": pd.array([u if p is None else first[p] for p, u in zip(parent, up, strict=True)], dtype="Int64"), "n_convs": n, "n_children": [len(c) if c else 0 for c in children],
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "above": above,
    })


def prefix_trie(sequences: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each node of the trie of (conv_id, seq, sizes): conv_id (the smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Sequences may be empty or null (their end is the root); conv_ids are distinct. An empty table gives no node.
    """
    rows = cut(sequences.select("conv_id", F.coalesce("seq", F.array().cast("array<string>")).alias("seq"), F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes")).withColumn("whole", F.sha2(F.concat_ws("", "seq").cast("binary"), 256)))
    one = rows.groupBy("whole").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    # The arrays come from the row of the smallest id, so that no aggregate carries arrays.
    distinct = rows.join(one.select(F.col("first").alias("conv_id"), "n"), "conv_id").withColumnRenamed("conv_id", "first").join(_ends(rows.select("whole", "conv_id")), "first")
    open_ = cut(distinct.select("first", "n", "seq", "sizes", "ends_sha256", F.lit("").alias("key"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("string").alias("above"), F.lit(0).cast("long").alias("size")))

    parts: DataFrame | None = None
    split: list[DataFrame] = []  # nodes that were taken apart, by depth
    while True:
        depth = len(split)
        nodes = open_.groupBy("key").agg(
            F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.size("seq") - depth).alias("turns"), F.count("*").alias("rows"), F.max("size").alias("size"), F.max("up").alias("up"), F.max("above").alias("above"),
            F.max(F.when(F.size("seq") == depth, F.col("ends_sha256"))).alias("ends_sha256"),
        )
        # The root is always taken apart. What else is has two distinct sequences at least, and turns beyond its own.
        large = cut(nodes.where((F.col("turns") > part_turns) & (F.col("rows") > 1) if depth else F.lit(True)))
        if large.isEmpty():
            parts = open_ if parts is None else parts.unionByName(open_)
            break
        fit = open_.join(large.select("key"), "key", "left_anti")
        if depth:
            parts = fit if parts is None else parts.unionByName(fit)
        split.append(large)
        next_ = open_.drop("up", "above").join(large.select("key", F.col("conv_id").alias("up")), "key").where(F.size("seq") > depth)
        digest = F.element_at("seq", depth + 1)
        open_ = cut(next_.withColumn("above", F.col("key")).withColumn("key", F.sha2(F.concat("key", digest).cast("binary"), 256)).withColumn("depth", F.lit(depth + 1)).withColumn("size", F.element_at("sizes", depth + 1)))

    # Each task gets whole subtries: some more buckets than parts of full size, so that a few large ones may meet.
    total = parts.agg(F.sum(F.size("seq"))).first()[0] or 0
    buckets = max(32, 4 * total // part_turns)
    built = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(build, _NODE)
    built = cut(built)
    found, below = built.drop("above"), built.where("above is not null").select("above", "n_leaves", "saved_tokens")
    for depth, large in reversed(list(enumerate(split))):
        sums = below.groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        whole = cut(large.join(sums, "key", "left").select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("size") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "above",
        ))
        found, below = found.unionByName(whole.drop("above")), below.unionByName(whole.where("above is not null").select("above", "n_leaves", "saved_tokens"))
    return found
