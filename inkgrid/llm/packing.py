"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity.

Documents are tokenised and cut where they are read. What travels on is a row of a few numbers for
each piece; rows are dealt by hash into shards of bounded size, and each shard places its pieces one by one
where the squared counts of open sequences per residual gap become smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unused
from .token_counts import _PYTHON_ONLY_SPACE, splits_at_space, text_groups, worker_cache

#: Documents of a shard. Sum-of-squares leaves a few sequences open at the end of each, so larger shards waste less
#: (0.1 % of the sequences at 50,000 documents, 1.4 % at 5,000).
SHARD_DOCS = 50_000
#: Pieces of less than this share of a sequence are placed last, the longest first: they fill what the others leave.
SMALL = 1 / 8
SEPARATOR = b"\0\0\0\0"


class SumOfSquares:
    """Open sequences by residual gap; place() puts one piece where the sum of squared counts grows least."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to capacity tokens; ties go to the smallest gap left, then to a new sequence last."""
        counts, full = self.counts, self.capacity
        # Moving a sequence from gap g to g - length changes the sum by 2 * (counts[g - length] - counts[g] + 1);
        # filling it up takes it out of the counts, and a new one only comes in.
        gaps = np.flatnonzero(counts[length:full]) + length
        new = 2 * counts[full - length] + 1 if length < full else 0
        if len(gaps):
            change = 2 * (counts[gaps - length] - counts[gaps] + 1)
            if gaps[0] == length:
                change[0] = 1 - 2 * counts[length]
            k = int(np.argmin(change))
            if change[k] <= new:
                gap = int(gaps[k])
                sequence = self.open[gap].pop()
                counts[gap] -= 1
                self._leave(sequence, gap - length)
                return sequence, full - gap
        sequence = self.made
        self.made += 1
        self._leave(sequence, full - length)
        return sequence, 0

    def _leave(self, sequence: int, gap: int) -> None:
        if gap:
            self.counts[gap] += 1
            self.open[gap].append(sequence)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_entries: int | None = None) -> DataFrame:
    """Tokenise and cut: (id_col, piece, start, length, ids_crc32), and ids (array of int) if asked for.

    A document is its tokens and one separator, id 0; only longer ones are cut, and only their last piece is shorter
    than capacity. A null text counts as empty, so it is the separator alone. cache_entries bounds what a worker remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache(path, False, entries=cache_entries)
        by_space = splits_at_space(own.tok)
        width = 4 * capacity
        for batch in batches:
            at = 0
            for group in text_groups(t.as_py() for t in batch.column(1)):
                split = [text.split() if by_space else [] for text in group]
                extra = own.fill(split)
                rows: list[tuple] = []
                known = own.by_piece.__getitem__
                for k, (text, parts) in enumerate(zip(group, split, strict=True)):
                    if not by_space or any(c in text for c in _PYTHON_ONLY_SPACE):
                        data = own.whole(text)
                    elif extra and not extra.keys().isdisjoint(parts):
                        data = b"".join([extra[p] if p in extra else known(p) for p in parts])
                    else:
                        data = b"".join(map(known, parts))
                    data += SEPARATOR
                    for piece, start in enumerate(range(0, len(data), width)):
                        part = data[start : start + width]
                        rows.append((at + k, piece, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None))
                columns = list(zip(*rows, strict=True))
                out = [batch.column(0).take(pa.array(columns[0])), *[pa.array(c, pa.int64()) for c in columns[1:5]]]
                out += [pa.array(columns[5], pa.list_(pa.int32()))] if with_ids else []
                yield pa.record_batch(out, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])
                at += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def place(found: DataFrame, shards: int, capacity: int = 2048) -> DataFrame:
    """The rows of found, which have a length of 1 to capacity, with sequence_id and offset.

    Full pieces are sequences of their own. Shards are told apart in sequence_id, whose numbers have gaps. A shard's
    pieces are placed in an order that is fixed by the rows themselves, so that a task that is run again gives the same.
    """
    own = found.columns
    late = F.when(F.col("length") < capacity * SMALL, -F.col("length")).otherwise(-capacity)
    dealt = found.withColumn("_deal", F.xxhash64(*own)).repartition(shards, "_deal").sortWithinPartitions(late, "_deal", *own).drop("_deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SumOfSquares(capacity)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [own.place(n) for n in batch.column("length").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields] + ["sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_entries: int | None = None) -> DataFrame:
    """Tokenise, cut and place: (id_col, piece, start, length, ids_crc32, sequence_id, offset), and ids if asked for.

    Every row of docs is a document, with repeated and null ids too. Other columns are not read; an empty table gives
    an empty result. Token ids are written once and joined to their places; placing itself only sees rows of numbers.
    """
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    found = pieces(docs, path, capacity, id_col, text_col, with_ids, cache_entries)
    if not with_ids:
        return place(found, shards, capacity)
    row = unused(found, "_row")
    kept = cut(found.withColumn(row, F.monotonically_increasing_id()))
    placed = place(kept.drop("ids"), shards, capacity)
    return placed.join(kept.select(row, "ids"), row).select(*[c for c in placed.columns if c != row], "ids")
