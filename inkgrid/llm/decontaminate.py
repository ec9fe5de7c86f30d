"""Benchmark decontamination with DataFrame functions only.

Item-sized windows of a document are fingerprinted with SimHash over their word shingles and joined to the items'
fingerprints through multi-index Hamming blocks: a fingerprint is cut into four blocks of 16 bits, and fingerprints within
RADIUS differ by NEAR bits at most in one of them. The items' side posts every value within NEAR of each of its blocks, so one
equi join finds all pairs within RADIUS, and lets through one in seven of the others. What lies within RADIUS is verified
by the exact weighted similarity of the shingles (weights are their repeats).

A window that shares no shingle with an item has similarity 0 to it, so only windows on which some shingle
lies where an item has it are fingerprinted: each maximal run of words in common gives one window. Shingles
are hashed and probed against the items' shingles in the scan's own stage; nothing of a clean document is shuffled.
Equal windows, such as a passage that many documents hold, are fingerprinted, joined and verified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

WIDTH = 5
SIMILARITY = 0.8
#: Blocks of a fingerprint, and bits by which the nearest of them differs at most.
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
NEAR = 4
#: Differing bits up to which no pair is lost, as five in each block make more. Windows of similarity 0.8 differ in about
#: 10 of 64 bits, with a deviation of 3.
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Bytes of the items' shingle table up to which it is broadcast; a larger one is joined by shuffle. A row has four numbers.
BROADCAST_BYTES = 64_000_000
ROW_BYTES = 40
#: What separates words here: anything but letters, digits and marks, so that case, punctuation and line breaks don't hide a copy.
APART = r"[^\p{L}\p{N}\p{M}]+"


def words(text: Column) -> Column:
    """Lower-cased words; null for a null text."""
    return F.array_remove(F.split(F.lower(text), APART), "")


def _shingles(column: str, width: int) -> str:
    """SQL for the shingles of an array of words; fewer words than width are one shingle."""
    return f"transform(sequence(0, greatest(0, size({column}) - {width})), i -> array_join(slice({column}, i + 1, {width}), ' '))"


def _simhash(column: str) -> str:
    """SQL for the SimHash of an array of shingles, repeats included."""
    hashes = f"transform({column}, s -> xxhash64(s))"
    bit = "CASE WHEN 2 * size(filter(h, x -> (shiftrightunsigned(x, b) & 1L) = 1L)) > size(h) THEN shiftleft(1L, b) ELSE 0L END"
    return f"element_at(transform(array({hashes}), h -> aggregate(sequence(0, 63), 0L, (a, b) -> a | {bit})), 1)"


def _similarity(a: str, b: str) -> str:
    """SQL for the weighted Jaccard similarity of two arrays of shingles, the weights being their repeats."""
    common = f"aggregate(array_distinct({a}), 0, (n, s) -> n + least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))"
    return f"element_at(transform(array({common}), c -> c / (size({a}) + size({b}) - c)), 1)"


def _block(fp: str, k: str) -> str:
    """SQL: the k-th block of a fingerprint."""
    return f"cast(shiftrightunsigned({fp}, {k} * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L AS int)"


def _candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows (window, n, a, fp) with the items (item_id, n, b, fp) of their length within RADIUS, and how far apart."""
    blocks = f"sequence(0, {BLOCKS - 1})"
    asked = windows.select("*", F.expr(f"explode({blocks})").alias("block")).withColumn("bits", F.expr(_block("fp", "block")))
    moved = f"transform(filter(sequence(0, {(1 << BLOCK_BITS) - 1}), m -> bit_count(m) <= {NEAR}), m -> {_block('fp', 'block')} ^ m)"
    posted = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.expr(f"explode({blocks})").alias("block"), F.col("fp")).select("item_id", "n", "item_fp", "block", F.explode(F.expr(moved)).alias("bits"))
    # Sorted and merged: the posted values are 10,000 for each item, more than their estimated size says, and no table to broadcast.
    met = asked.join(posted.hint("merge"), ["n", "block", "bits"]).withColumn("apart", F.expr("fp ^ item_fp"))
    # A pair that is near in several blocks is kept at the first.
    first = f"NOT exists({blocks}, j -> j < block AND bit_count({_block('apart', 'j')}) <= {NEAR})"
    near = met.where(F.expr(f"bit_count(apart) <= {RADIUS} AND {first}"))
    return near.select("window", "n", "a", "item_id", F.bit_count("apart").alias("hamming")).join(items.select("item_id", "n", "b"), ["item_id", "n"])


def _hits(docs: DataFrame, items: DataFrame, width: int, broadcast_bytes: int) -> DataFrame:
    """Windows (id, n, start, window) at which a shingle of the document lies where an item of n words has it.

    width: the length of these items' shingles.
    """
    at = lambda i: F.get("words", F.col("p") + i)
    own = items.select("item_id", "n", "words", F.explode(F.expr(f"sequence(0, n - {width})")).alias("p"))
    own = own.select(F.xxhash64(*[at(i) for i in range(width)]).alias("h"), "n", F.col("p").alias("q"), at(-1).alias("before")).distinct()
    rows = docs.where(F.size("words") >= width)
    broadcast = ROW_BYTES * own.count() <= broadcast_bytes
    if not broadcast:
        # A row's own number joins its positions back to it, as ids may repeat.
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    shingles = rows.select("*", F.explode(F.expr(f"sequence(0, size(words) - {width})")).alias("p"))
    shingles = shingles.select("*", F.xxhash64(*[at(i) for i in range(width)]).alias("h"))
    met = shingles.join(F.broadcast(own), "h") if broadcast else shingles.select("row", "p", "h").join(own, "h").join(rows, "row")
    first = met.where((F.col("q") == 0) | (F.col("p") == 0) | ~F.get("words", F.col("p") - 1).eqNullSafe(F.col("before")))
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.size("words") - F.col("n")))
    return first.select("id", "n", start.alias("start"), "words").selectExpr("id", "n", "start", "slice(words, start + 1, n) AS window")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Return (id_col, item_id, start, n_words, hamming, similarity) for every document and item that it holds.

    The window given is the most similar one (then the nearest fingerprint, then the first). start counts words from 0.
    Items of fewer than WIDTH words are one shingle of all their words; items and documents without a word, null ones
    included, match nothing. Rows that share an id count as one document; rows with a null id are left out. Ids may be of any
    type. Repeated items are compared once; texts may be of any length. Only the two named columns of docs and item_id and
    text of benchmark are read.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where("item_id IS NOT NULL AND size(words) > 0").distinct().withColumn("n", F.size("words"))
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    widths = sorted(r[0] for r in items.select(F.least("n", F.lit(WIDTH))).distinct().collect())
    found = None
    for width in widths:
        # Windows and items of one shingle length only meet each other.
        these = items.where(F.least("n", F.lit(WIDTH)) == width)
        # Cut here: conditions on what follows would otherwise move into the scan's stage and take its loops apart.
        hits = cut(_hits(own, these, width, broadcast_bytes).withColumn("key", F.sha2(F.array_join("window", " "), 256)))
        windows = hits.groupBy("key", "n").agg(F.first("window").alias("window"))
        windows = cut(windows.withColumn("a", F.expr(_shingles("window", width))).withColumn("fp", F.expr(_simhash("a"))).select(F.col("key").alias("window"), "n", "a", "fp"))
        known = cut(these.withColumn("b", F.expr(_shingles("words", width))).withColumn("fp", F.expr(_simhash("b"))).select("item_id", "n", "b", "fp"))
        alike = _candidates(windows, known).select(F.col("window").alias("key"), "item_id", "n", "hamming", F.expr(_similarity("a", "b")).alias("similarity")).where(F.col("similarity") >= similarity)
        near = hits.select("id", "start", "n", "key").join(alike, ["key", "n"]).select("id", "item_id", "start", "n", "hamming", "similarity")
        found = near if found is None else found.union(near)
    if found is None:
        found = own.join(items.select("item_id", "n"), F.lit(False)).selectExpr("id", "item_id", "0 AS start", "n", "0 AS hamming", "0D AS similarity")
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("near"), (-F.col("start")).alias("early"), "n")).alias("best")
    return found.groupBy("id", "item_id").agg(best).select(F.col("id").alias(id_col), "item_id", (-F.col("best.early")).cast("long").alias("start"), F.col("best.n").cast("long").alias("n_words"), (-F.col("best.near")).cast("long").alias("hamming"), F.col("best.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no item. Each row is judged by its own text, whatever its id."""
    row = unused(docs, "_row")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    leaks = find_leaks(keyed, benchmark, row, text_col).select(row).distinct()
    return keyed.join(leaks, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
