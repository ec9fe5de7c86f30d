"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most 3 bits share at
least 5 of them. Single bytes have only 2048 posting lists, each a growing share of all documents, so
the index intersects them three at a time: of any 5 positions, 3 lie in the same half of the
fingerprint, so the 8 triples within halves meet every such pair in at least one list of 24 fixed bits.
Inside a list the shared positional bytes of each pair are tallied, pairs with 5 or more are retained,
and those are verified by their differing bits.

Equal fingerprints are one entry of the index, so groups of exact copies cost nothing. A list that
grows beyond LIST_LIMIT is dealt again by every pair of its remaining bytes, i.e. by exactly the
guaranteed 5 shared bytes; such a list differs in 24 bits only and is worked off by looking up every
neighbour within 3 bits, in time linear in its length. A list's links are given as a forest, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import components, forest

BITS = 64
RADIUS = 3
#: Positional bytes that two fingerprints within RADIUS share at least.
MIN_SHARED = BITS // 8 - RADIUS
#: Posting lists up to this length are tallied pair by pair in one task.
LIST_LIMIT = 1024
#: Shingle hashes are turned into bits in blocks of so many.
BLOCK = 65_536
#: The positional bytes that key the first index: all triples of either half.
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, width: int) -> int:
    """SimHash over the word shingles of a text, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode(errors="replace").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, fp long) for every row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), width)) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _list_edges(fps: np.ndarray, reps: np.ndarray) -> tuple[list[int], list[int]]:
    """Tally, retain and verify the pairs of one posting list; each entry is linked to the first one within reach."""
    left, right = [], []
    for i in range(len(fps) - 1):
        apart = fps[i + 1 :] ^ fps[i]
        shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        retained = np.flatnonzero(shared >= MIN_SHARED)
        linked = retained[np.bitwise_count(apart[retained]) <= RADIUS] + i + 1
        left += [int(reps[i])] * len(linked)
        right += reps[linked].tolist()
    return forest(left, right)


def _neighbour_edges(fps: np.ndarray, reps: np.ndarray, free: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Links of a long list whose entries differ in the given bytes only, by looking up every neighbour."""
    order = np.argsort(fps)
    fps, reps = fps[order], reps[order]
    bits = [np.uint64(1 << (8 * p + b)) for p in free for b in range(8)]
    left: list[int] = []
    right: list[int] = []
    for n in range(1, RADIUS + 1):
        for chosen in combinations(bits, n):
            other = fps ^ np.bitwise_or.reduce(np.array(chosen))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = np.flatnonzero((fps[at] == other) & (fps < other))
            if len(hit):
                left += reps[hit].tolist()
                right += reps[at[hit]].tolist()
        left, right = forest(left, right)
    return left, right


def _links(index: DataFrame, limit: int | None) -> DataFrame:
    """Edges (u, v, fp null) of the posting lists of index (list, key, fp, rep), and (null, rep, fp, ...) of lists beyond limit.

    Rows of a list follow one another in a task. A list is held up to limit entries; a longer one passes through.
    Without limit the list is one of five fixed bytes, of at most 2^24 entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v", "fp", "list"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        held: tuple[int, int] | None = None
        chunks: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        out: list[list] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(x, k) for x, k in zip(out, types, strict=True)], names=names)
            for x in out:
                x.clear()
            return made

        def passed(fps: np.ndarray, reps: np.ndarray) -> None:
            n = len(fps)
            for x, new in zip(out, ([None] * n, reps.tolist(), fps.view(np.int64).tolist(), [held[0]] * n), strict=True):
                x += new

        def close() -> None:
            nonlocal chunks, size
            if size > 1 and chunks:
                fps, reps = (np.concatenate([c[k] for c in chunks]) for k in (0, 1))
                if size <= LIST_LIMIT:
                    u, v = _list_edges(fps, reps)
                else:
                    u, v = _neighbour_edges(fps, reps, _REST[held[0]])
                for x, new in zip(out, (u, v, [None] * len(u), [None] * len(u)), strict=True):
                    x += new
            chunks, size = [], 0

        for batch in batches:
            number, key, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.int64).view(np.uint64)
            if not len(number):
                continue
            starts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], len(number)]
            first = (int(number[0]), int(key[0]))
            # Only lists of two entries or more matter, and the first and last, which may go on in another batch.
            for k in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)):
                s, e = starts[k], ends[k]
                this = (int(number[s]), int(key[s])) if k else first
                if this != held:
                    close()
                    held = this
                size += e - s
                chunks.append((fp[s:e], rep[s:e]))
                if limit and size > limit:
                    for c in chunks:
                        passed(*c)
                    chunks = []
            if len(out[0]) > 50_000:
                yield flush()
        close()
        yield flush()

    dealt = index.repartition("list", "key").sortWithinPartitions("list", "key")
    return dealt.select("list", "key", "fp", "rep").mapInArrow(run, "u long, v long, fp long, list int")


#: The second index: each triple with each pair of the other bytes, and what remains free.
_FIVES = [(t, p) for t in range(len(TRIPLES)) for p in combinations(sorted(set(range(8)) - set(TRIPLES[t])), 2)]
_REST = [tuple(sorted(set(range(8)) - set(TRIPLES[t]) - set(p))) for t, p in _FIVES]


def _index(entries: DataFrame, masks: list[tuple[int | None, int, int]]) -> DataFrame:
    """Posting rows (list, key, fp, rep); masks: (only for rows of this list, list, mask)."""
    rows = [F.when(F.lit(True) if only is None else F.col("list") == only, F.struct(F.lit(number).alias("list"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))) for only, number, mask in masks]
    return entries.select("fp", "rep", F.explode(F.array_compact(F.array(*rows))).alias("p")).select("p.list", "p.key", "fp", "rep")


def link(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Return (fp, component_id) for every fingerprint of prints (id_col, fp).

    The representative of equal fingerprints is their smallest id; null ids are left out. Ids that are no integers are
    linked by numbers of their own, one for each fingerprint, and the smallest id of a component is looked up after.
    """
    numbers = isinstance(prints.schema[id_col].dataType, T.IntegralType)
    entries = prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("least"))
    entries = cut(entries.withColumn("rep", F.col("least") if numbers else F.monotonically_increasing_id()))
    first = cut(_links(_index(entries, [(None, k, _mask(t)) for k, t in enumerate(TRIPLES)]), LIST_LIMIT))
    edges = first.where("u is not null").select("u", "v")
    long_lists = first.where("u is null").select(F.col("v").alias("rep"), "fp", "list")
    if not long_lists.isEmpty():
        again = _index(long_lists, [(t, k, _mask(TRIPLES[t] + p)) for k, (t, p) in enumerate(_FIVES)])
        edges = edges.union(_links(again, None).select("u", "v"))
    roots = components(edges)
    rooted = entries.join(roots, F.col("rep") == F.col("vertex"), "left").select("fp", "least", F.coalesce("root", "rep").alias("component_id"))
    if numbers:
        return rooted.drop("least")
    named = rooted.groupBy("component_id").agg(F.min("least").alias("name"))
    return rooted.join(named, "component_id").select("fp", F.col("name").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id_col, fingerprint (16 hex digits) and component_id for every row of docs.

    Ids may be of any type that has an order. component_id is the smallest id that is reachable over links of at most 3
    differing bits, the row's own included.
    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with equal ids are one
    vertex if their fingerprints are equal, and otherwise each row follows its own fingerprint. A null id is no
    vertex: its row has a null component_id. Other columns are not read; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, width, id_col, text_col))
    joined = prints.join(link(prints, id_col), "fp", "left")
    component = F.when(F.col(id_col).isNotNull(), F.col("component_id"))
    return joined.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
