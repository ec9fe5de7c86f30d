"""Importance resampling of documents towards the n-gram distribution of target texts.

Features are runs of consecutive words, hashed by their CRC-32 into buckets. No run is ever put together as a string: each
distinct word's CRC is computed once, and the CRC of a run follows by algebra. A CRC is linear over GF(2), so
crc(a + b) = M(len(b)) crc(a) ^ crc(b), where M(n) shifts a CRC over n zero bytes; M is kept as four tables of 256 entries for
each short length, and composed of powers of two for the rest.

Two passes over the texts, each scan -> map: one counts buckets (a task sends one row for each bucket at most), one weighs and
scores documents. Ranks come from a range-partitioned sort with an offset for each partition, never from one task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unused
from .token_counts import GROUP_CHARS

#: Lengths (in bytes) that have tables of their own, and words that a worker keeps the CRC of.
SHORT = 64
CACHE_WORDS = 500_000
#: Bytes that are part of a word, once A-Z is lower case.
_WORD = bytes(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_CLEAN = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _through(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A shift, as tables (4, 256), applied to CRCs."""
    return tables[0][crcs & 255] ^ tables[1][(crcs >> 8) & 255] ^ tables[2][(crcs >> 16) & 255] ^ tables[3][crcs >> 24]


@cache
def _power(k: int) -> np.ndarray:
    """Tables of the shift over 2 ** k bytes: one zero byte for k = 0, else the shift before, twice."""
    if k:
        return np.stack([_through(_power(k - 1), row) for row in _power(k - 1)])
    one = np.arange(256, dtype=np.uint32)
    # Without the initial and final complement, feeding a zero byte maps c to (c >> 8) ^ R[c & 255].
    r = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    return np.stack([r, *[one << np.uint32(8 * j - 8) for j in (1, 2, 3)]])


@cache
def _short() -> np.ndarray:
    """Tables (SHORT, 4, 256) of the shifts over 0 to SHORT - 1 bytes."""
    found = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])]
    for _ in range(1, SHORT):
        found.append(np.stack([_through(_power(0), row) for row in found[-1]]))
    return np.stack(found)


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs (unsigned 32-bit) moved over so many zero bytes each."""
    tables = _short()
    near = np.minimum(lengths, SHORT - 1)
    out = tables[near, 0, crcs & 255] ^ tables[near, 1, (crcs >> 8) & 255] ^ tables[near, 2, (crcs >> 16) & 255] ^ tables[near, 3, crcs >> 24]
    far = np.flatnonzero(lengths >= SHORT)
    if len(far):
        moved, left = crcs[far], lengths[far]
        for k in range(int(left.max()).bit_length()):
            on = (left >> k) & 1 == 1
            moved[on] = _through(_power(k), moved[on])
        out[far] = moved
    return out


def run_crcs(crcs: np.ndarray, lengths: np.ndarray, texts: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, CRC) of all runs of 1, 2, ... longest words that stay in one text; words are joined by one space."""
    space = np.uint32(zlib.crc32(b" "))
    runs = crcs
    yield texts, runs
    for n in range(1, longest):
        if len(runs) < 2:
            return
        left = shift(runs[:-1], np.ones(len(runs) - 1, np.int64)) ^ space
        runs = shift(left, lengths[n:]) ^ crcs[n:]
        inside = texts[n:] == texts[:-n]
        yield texts[n:][inside], runs[inside]


class _WordCrcs(dict):
    """CRC and length of each word, computed at first sight and kept."""

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) | len(word) << 32
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


_words = _WordCrcs()


def _grouped(column: pa.Array) -> Iterator[list[bytes]]:
    """UTF-8 texts in order, in groups of bounded size; null is the empty text."""
    group: list[bytes] = []
    size = 0
    for text in column:
        group.append(text.as_py() or b"")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def features(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and (text, bucket) of all features."""
    split = [t.translate(_CLEAN).split() for t in texts]
    counts = np.array([len(words) for words in split], np.int64)
    packed = np.fromiter((_words[w] for words in split for w in words), np.uint64, int(counts.sum()))
    crcs, lengths = (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32), (packed >> np.uint64(32)).astype(np.int64)
    parts = list(run_crcs(crcs, lengths, np.repeat(np.arange(len(texts)), counts), longest))
    return counts, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000, longest: int = 2) -> np.ndarray:
    """Features of all texts in each bucket: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in _grouped(batch.column(0)):
                total += np.bincount(features(group, buckets, longest)[2], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed probability under the target over the one under the source), for each bucket."""
    k = len(source)
    all_source, all_target = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise of an id, in thousandths: equal in every run."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight, score) of every document; the weight is the floored mean of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            at = 0
            for group in _grouped(batch.column(1)):
                n_words, text, bucket = features(group, len(by_bucket), longest)
                n = np.bincount(text, minlength=len(group))
                order = np.argsort(text, kind="stable")
                summed = np.zeros(len(group), np.int64)
                held = np.flatnonzero(n)
                if len(held):
                    summed[held] = np.add.reduceat(by_bucket[bucket[order]], (np.cumsum(n) - n)[held])
                weight = summed // np.maximum(n, 1)
                ids = batch.column(0).slice(at, len(group))
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.record_batch([ids, *[pa.array(x, pa.int64()) for x in (n_words, n, weight, score)]], names=["id", "n_words", "n_features", "weight", "score"])
                at += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long").withColumnRenamed("id", id_col)


def ranked(rows: DataFrame, *order: F.Column) -> DataFrame:
    """rows with their place (1, 2, 3, ...) in that order as `rank`. The sort is range-partitioned; a place is the place in the
    partition and the number of rows before it, one number for each partition."""
    at = unused(rows, "_at")
    placed = cut(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(at, 33)
    sizes = sorted((p, n) for p, n in placed.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long")
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("rank", F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at, "_part", "_before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, longest: int = 2, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Return (id_col, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Of the N documents with min_words words, floor(percent * N / 100) are drawn, highest score first, ties to the smaller id.
    A null text has no words: no features, weight 0, never drawn. A null id comes after all others and its noise is that of
    an empty id; rows that repeat are drawn each by itself, in any order among equal ones. Empty documents give an empty
    result; an empty target counts as none of every bucket. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    scored = cut(weigh(docs, gain, longest, seed, id_col, text_col))
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    ordered = ranked(fit, F.desc("score"), F.asc_nulls_last(id_col)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ordered.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))).select(id_col, "n_features", "weight", "score", "rank")
