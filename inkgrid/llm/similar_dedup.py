"""Near-duplicates of a Jaccard similarity on word shingles, beyond what equal or close SimHashes show.

SimHashes of five-word shingles within 3 bits are all but equal texts, so similar ones are found by a second
fingerprint of 64 positional bytes, each from the smallest of the shingles' hashes under one permutation: two texts
share a byte about as often as they share shingles. The index keys four positional bytes at a time; pairs of a list
are tallied by the bytes that they share, retained from MIN_BYTES on, and verified on their whole shingle sets.

Guarantee: two texts of similarity s share all bytes of a key with probability s^4, so one of 0.8 misses all 16 keys with
probability 0.0002, and shares fewer than MIN_BYTES bytes with probability 0.00003; no pair is dropped for any other reason.

Large groups give no pairs. Every list has a pivot, the entry whose own lists are the longest, i.e. the most central text;
entries meet it first, and most are linked by that. What is left of a list is decided exactly without meeting one by one:

* Entries near their pivot (MIN_BYTES shared) are told by their difference to it: the shingles that they lack and those that
  they add. Two of them are similar only if their differences overlap by g(x) + g(y), with g = s / (1 + s) * size + lacking -
  size of the pivot / 2. So the pairs to look at are those that share an element among the rarest of their differences
  (the prefix filter of set joins), with enough elements left behind it to reach the overlap.
* Entries far from their pivot are unlike it, and there may be many (pages of one template with half of their words in common). In
  lists of up to MEET entries they meet the others one by one, which is linear in the entries. The members of longer lists go
  through a prefix filter over their whole shingle sets: texts of n shingles are similar only if they share one of the n - sn + 1
  that are rarest among these texts, with enough of them left behind it; a template's own shingles are not among those.
* Lists whose entries are all connected by then ask for nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import simhash_dedup
from .common import cut
from .components import components

POSITIONS = 64
BAND = 4
#: Shared bytes from which pairs are verified: four deviations below what a similarity of 0.8 gives (51 of 64).
MIN_BYTES = 38
#: Entries of a list that meet one by one; beyond, the prefix filter over whole shingle sets decides (either way is exact).
MEET = 32
#: Overlaps are compared with so much to spare, for sums of fractions.
SLACK = 1e-6
#: Shingle hashes are permuted in blocks of so many.
BLOCK = 16_384
#: The lowest bit of each of eight bytes.
_LOWEST = 0x0101010101010101
_PARTS = [f"s{k}" for k in range(POSITIONS // 8)]


def _multipliers() -> np.ndarray:
    return np.random.default_rng(42).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int) -> set[bytes]:
    """Distinct shingles of the words with A-Z lower-cased; fewer words than width are one, no words none."""
    words = (text or "").encode(errors="replace").lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def sketch(text: str | None, width: int) -> np.ndarray | None:
    """The 64 positional bytes of a text as eight 64-bit numbers; None without words."""
    from xxhash import xxh64_intdigest

    own = shingles(text, width)
    if not own:
        return None
    hashes = np.fromiter(map(xxh64_intdigest, own, repeat(7)), dtype=np.uint64, count=len(own))
    least = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK]
        least = np.minimum(least, [(part * a).min() for a in _multipliers()])
    return (least >> np.uint64(20)).astype(np.uint8).view(np.int64)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(id long, s0 .. s7) of docs (id, text); texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i.as_py(), s) for i, t in zip(*batch.columns, strict=True) if (s := sketch(t.as_py(), width)) is not None]
            parts = np.array([s for _, s in found]).reshape(-1, len(_PARTS))
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), *[pa.array(np.ascontiguousarray(p)) for p in parts.T]], names=["id", *_PARTS])

    return docs.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"{p} long" for p in _PARTS))


def _shared(a: str, b: str) -> Column:
    """How many positional bytes two sketches share: those of a ^ b without a bit, once a byte's bits are folded into its lowest."""
    folded = []
    for p in _PARTS:
        bits = f"({a}.{p} ^ {b}.{p})"
        for k in (1, 2, 4):
            bits = f"({bits} | shiftrightunsigned({bits}, {k}))"
        folded.append(f"bit_count({bits} & {_LOWEST}L)")
    return F.lit(POSITIONS) - F.expr(" + ".join(folded))


def _verify(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (c.to_pylist() for c in batch.columns[:2])
            left, right = ((t.as_py() for t in c) for c in batch.columns[2:])  # one text at a time, not a batch's
            kept, last, mine = [], None, set()
            for k, (i, a, b) in enumerate(zip(v, left, right, strict=True)):
                if i != last:
                    last, mine = i, shingles(b, width)
                other = shingles(a, width)
                both = len(mine & other)
                if both >= similarity * (len(mine) + len(other) - both):
                    kept.append(k)
            yield pa.record_batch([pa.array([x[k] for k in kept], pa.int64()) for x in (u, v)], names=["u", "v"])

    texts = docs.select("id", "text")
    met = pairs.join(texts.selectExpr("id AS u", "text AS a"), "u").join(texts.selectExpr("id AS v", "text AS b"), "v")
    return met.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _hashes(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit numbers of a text's shingles, ascending."""
    from xxhash import xxh64_intdigest

    own = shingles(text, width)
    return np.unique(np.fromiter(map(xxh64_intdigest, own, repeat(7)), dtype=np.uint64, count=len(own)).view(np.int64))


def _differences(members: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(v, u, e, size, least, g) of members (v, u, apart): each element e of the difference between the shingles of u and
    those of its pivot v, how many there are, how many of them a partner shares at least, and g.

    apart: whether u is not connected with the pivot. Only pairs with such an entry are asked for, and it is not similar to
    the pivot, so that g(u) + g(v) > 0; that gives the least overlap for it and for its partners.
    """
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, u, apart = (c.to_pylist() for c in batch.columns[:3])
            pivot, text = ((t.as_py() for t in c) for c in batch.columns[3:])
            out: list[list] = [[], [], [], [], [], []]
            last, mine = None, np.array([], dtype=np.int64)
            for i, j, alone, a, b in zip(v, u, apart, pivot, text, strict=True):
                if i != last:
                    last, mine = i, _hashes(a, width)
                own = _hashes(b, width)
                lacks = np.setdiff1d(mine, own, assume_unique=True)
                adds = np.setdiff1d(own, mine, assume_unique=True)
                g = share * len(own) + len(lacks) - len(mine) / 2
                g_pivot = (share - 0.5) * len(mine)
                least = max(1, math.ceil((g + g_pivot if alone else g - g_pivot) - SLACK))
                found = np.concatenate([lacks, adds])
                if least <= len(found):
                    for column, value in zip(out, (repeat(i, len(found)), repeat(j, len(found)), found.tolist(), repeat(len(found), len(found)), repeat(least, len(found)), repeat(g, len(found))), strict=True):
                        column.extend(value)
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, [*[pa.int64()] * 5, pa.float64()], strict=True)], names=["v", "u", "e", "size", "least", "g"])

    texts = docs.select("id", "text")
    met = members.join(texts.selectExpr("id AS u", "text AS b"), "u").join(texts.selectExpr("id AS v", "text AS a"), "v")
    return met.select("v", "u", "apart", "a", "b").mapInArrow(run, "v long, u long, e long, size long, least long, g double")


def _overlapping(members: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of members (v, u, apart, root) of one pivot v that may be similar and aren't connected, by the prefix filter."""
    elements = cut(_differences(members.select("v", "u", "apart"), docs, width, similarity))
    # The rarest elements first; the same order for all members of a pivot.
    often = elements.groupBy("v", "e").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("v", "u").orderBy("n", "e"))
    posted = elements.join(often, ["v", "e"]).withColumn("rank", rank).where("rank <= size - least + 1").withColumn("left", F.col("size") - F.col("rank") + 1)
    posted = cut(posted.join(members, ["v", "u"]).select("v", "e", "u", "left", "g", "apart", "root"))
    a = posted.where("apart").select("v", "e", F.col("u").alias("a"), F.col("left").alias("left_a"), F.col("g").alias("g_a"), F.col("root").alias("root_a"))
    b = posted.select("v", "e", F.col("u").alias("b"), F.col("left").alias("left_b"), F.col("g").alias("g_b"), F.col("root").alias("root_b"), "apart")
    reach = F.least("left_a", "left_b") >= F.col("g_a") + F.col("g_b") - SLACK
    met = a.join(b, ["v", "e"]).where((F.col("root_a") != F.col("root_b")) & (~F.col("apart") | (F.col("a") < F.col("b"))) & reach)
    return met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _elements(members: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(u, e, size): every shingle e of the texts of members (u), and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                own = _hashes(text.as_py(), width)
                yield pa.record_batch([pa.array(np.full(len(own), i.as_py())), pa.array(own), pa.array(np.full(len(own), len(own)))], names=["u", "e", "size"])

    texts = docs.select(F.col("id").alias("u"), "text")
    return texts.join(members.select("u"), "u", "left_semi").mapInArrow(run, "u long, e long, size long")


def _rarest(members: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(e, u, left, size, far, root) of members (u, far, root): the shingles of u's prefix that members of different roots
    share, and how many of u's shingles are as frequent or more so, e included."""
    elements = cut(_elements(members, docs, width))
    often = elements.groupBy("e").agg(F.count("*").alias("n")).where("n > 1")
    # What no other member has comes first, uncounted; the rest by frequency, in one order for all members.
    own = W.partitionBy("u")
    ranked = elements.join(often, "e").withColumn("rank", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "e")))
    prefix = ranked.where(F.col("rank") <= F.col("size") - F.ceil(similarity * F.col("size") - SLACK) + 1)
    posted = cut(prefix.join(members, "u").select("e", "u", (F.col("size") - F.col("rank") + 1).alias("left"), "size", "far", "root"))
    mixed = posted.groupBy("e").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("far").alias("asks")).where("low < high AND asks")
    return posted.join(mixed.select("e"), "e")


def _far_pairs(members: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of members (u, far, root), one of them far, that may be similar and aren't connected, by the prefix filter."""
    posted = _rarest(members, docs, width, similarity)
    share = similarity / (1 + similarity)
    a = posted.where("far").select("e", F.col("u").alias("a"), F.col("left").alias("left_a"), F.col("size").alias("size_a"), F.col("root").alias("root_a"))
    b = posted.select("e", F.col("u").alias("b"), F.col("left").alias("left_b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"), "far")
    reach = F.least("left_a", "left_b") >= share * (F.col("size_a") + F.col("size_b")) - SLACK
    met = a.join(b, "e").where((F.col("root_a") != F.col("root_b")) & (~F.col("far") | (F.col("a") < F.col("b"))) & reach)
    return met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _edges(docs: DataFrame, reps: DataFrame, known: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u, v) between similar rows of docs (id, text) with distinct ids, among those of reps (id); with the known
    links (u, v), as many as connect what is similar."""
    prints = cut(_sketches(docs.join(reps, "id", "left_semi"), width))
    keys = [F.xxhash64(F.lit(k), F.expr(f"shiftrightunsigned(s{k // 2}, {32 * (k % 2)}) & {0xFFFFFFFF}L")) for k in range(POSITIONS // BAND)]
    posted = prints.select("id", F.explode(F.array(*keys)).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(posted.join(lists, "key"))
    central = shared.groupBy("id").agg(F.sum("n").alias("central"))
    pivots = shared.join(central, "id").groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("early"))).alias("p")).select("key", (-F.col("p.early")).alias("pivot"))
    entries = cut(shared.select("key", "id").join(pivots, "key"))
    a, b = (prints.select(F.col("id").alias(c), F.struct(*_PARTS).alias(f"p{c}")) for c in "uv")
    to_pivot = entries.where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct()
    near = cut(to_pivot.join(a, "u").join(b, "v").where(_shared("pu", "pv") >= MIN_BYTES).select("u", "v"))
    edges = cut(_verify(near, docs, width, similarity))
    root = cut(components(edges.union(known)))

    def rooted(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.join(root.select(F.col("vertex").alias(of), F.col("root").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))

    members = rooted(rooted(near, "u", "root"), "v", "of_pivot").withColumn("apart", F.col("root") != F.col("of_pivot"))
    unsettled = members.where("apart").select("v").distinct()
    members = cut(members.join(unsettled, "v", "left_semi").select("v", "u", "apart", "root"))
    more = _verify(_overlapping(members, docs, width, similarity), docs, width, similarity)
    far = entries.where("id <> pivot").join(near.select(F.col("u").alias("id"), F.col("v").alias("pivot")), ["id", "pivot"], "left_anti").select("key", "id")
    here = entries.select("key", "id").join(far.select("key").distinct(), "key", "left_semi").join(far.withColumn("far", F.lit(True)), ["key", "id"], "left")
    placed = cut(rooted(here, "id", "root").withColumn("far", F.coalesce("far", F.lit(False))))
    unsettled = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
    placed = cut(placed.join(unsettled, "key"))
    short = placed.where(F.col("n") <= MEET).join(prints.select("id", F.struct(*_PARTS).alias("p")), "id")
    ask = short.where("far").select("key", F.col("id").alias("u"), F.col("p").alias("pu"), F.col("root").alias("ru"))
    others = short.select("key", F.col("id").alias("v"), F.col("p").alias("pv"), F.col("root").alias("rv"), "far")
    met = ask.join(others, "key").where((F.col("ru") != F.col("rv")) & (~F.col("far") | (F.col("u") > F.col("v"))) & (_shared("pu", "pv") >= MIN_BYTES))
    crowd = cut(placed.where(F.col("n") > MEET).groupBy(F.col("id").alias("u")).agg(F.max("far").alias("far"), F.min("root").alias("root")))
    rest = _far_pairs(crowd, docs, width, similarity).join(a, "u").join(b, "v").where(_shared("pu", "pv") >= MIN_BYTES)
    return edges.union(more).union(_verify(met.select("u", "v").union(rest.select("u", "v")).distinct(), docs, width, similarity))


def groups(rows: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Return (id, fingerprint, root) for every row of rows (id long, text), whose ids are distinct and not null, and
    which give the same rows each time they are read.

    Equal texts are one entry, by the smallest id; entries with equal or close SimHashes are linked, and so are all
    entries with similar shingle sets. root is an id of the group, the same for all its rows.
    """
    hashed = rows.select("id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("h"))
    texts = cut(hashed.groupBy("h").agg(F.min("id").alias("id")))
    distinct = rows.select("id", "text").join(texts.select("id"), "id", "left_semi")
    close = cut(simhash_dedup.near_duplicates(distinct, width, "id"))
    known = close.where("id <> component_id").select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    root = components(_edges(rows, close.select("id"), known, width, similarity).union(known))
    named = close.join(root, F.col("id") == F.col("vertex"), "left").select("id", "fingerprint", F.coalesce("root", "id").alias("root"))
    return hashed.join(texts.join(named, "id").drop("id"), "h", "left").select("id", "fingerprint", "root")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id_col, fingerprint and component_id for every row of docs, as simhash_dedup does, linked by similarity too.

    Links are SimHashes within 3 bits, and shingle sets of a Jaccard similarity of at least the given one. Null, empty and
    blank texts are linked with one another only. Every row is a vertex with its own text, so rows that share an id
    follow their texts; component_id is the smallest id of the row's group, and null for a row with a null id. Other columns are not
    read; an empty table gives none.
    """
    rows = cut(docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text")).withColumn("id", F.monotonically_increasing_id()))
    found = cut(rows.select("id", "of").join(groups(rows, width, similarity), "id"))
    least = found.groupBy("root").agg(F.min("of").alias("component_id"))
    return found.join(least, "root").select(F.col("of").alias(id_col), "fingerprint", F.when(F.col("of").isNotNull(), F.col("component_id")).alias("component_id"))
