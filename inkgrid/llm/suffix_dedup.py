"""Exact substring dedup: bytes of passages that a document with a smaller id holds too are removed.

Suffixes are put into buckets by an initial q-gram and refined by the bucket identifiers of later offsets, until a bucket holds
suffixes that agree in all `match` bytes; its smallest document keeps the passage. An identifier of 2q bytes is made of the two of
q bytes that it starts with and that stands q bytes later, so each level reuses those of the level before.

To sort all suffixes of a corpus would move many times its size. Three things keep that down, and neither loses a match:

- Only some suffixes open a bucket. Of the q-grams in each window of `match` bytes the one with the smallest hash is its anchor, so
  equal windows have equal anchors, at the same place. About one position in 17 is an anchor. A first round deals anchors by their
  hash (8 bytes each) and keeps those that at least two documents have.
- Of documents with equal texts only the one with the smallest id goes on: the others go as a whole.
- Only kept anchors ship text: the bytes of all windows whose anchor they are. The second round's tasks hold all windows of their
  anchors and refine them.

A task sends a hash once for all of its documents, so a bucket has a row for each task at most, however common the q-gram is. In
the second round it refines its own windows first and sends only those of its smallest document. Windows of an anchor that very
many documents have (there are at most ANCHORS_HOT of those) are dealt one by one, by their own hash: so what stands around a
common passage never meets in one task. Identifiers are 64-bit; windows that share them are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes of an anchor. Short ones are sparser, long ones are shared by chance less often.
ANCHOR = 16
#: Positions hashed at a time (their arrays stay in a core's cache), bytes of texts in a group, bytes of windows in a task of the second
#: round, and bytes of texts for each bucket of the first.
SLICE, GROUP_BYTES, TASK_BYTES, BUCKET_BYTES = 1 << 16, 16_000_000, 10_000_000, 48_000_000
#: Windows that a task of the second round compares at a time before it sends them.
PART_WINDOWS = 2_000_000
#: Documents that make an anchor hot, at least, and so many hot ones at most: the threshold grows with the corpus.
HOT_DOCS, ANCHORS_HOT = 20_000, 1_000_000
_LOW = np.uint64(0xFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads them evenly."""
    for by, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))
_ODD = _mixed(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def identifiers(data: np.ndarray, width: int) -> np.ndarray:
    """Of the `width` bytes from each position on. Each level joins identifiers of the one before with those of later offsets."""
    found, k = _BYTES[data], 1
    while k < width:
        step = min(k, width - k)  # the last level may overlap
        found = found[: max(0, len(found) - step)] * _ODD[k.bit_length()] + found[step:]
        k += step
    return found


def identifiers_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Identifiers at ascending positions, a slice at a time."""
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(data), SLICE):
        i, j = np.searchsorted(at, [a, a + SLICE])
        if i < j:
            out[i:j] = identifiers(data[a : a + SLICE + width - 1], width)[at[i:j] - a]
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    k = 1
    while k < width:
        step = min(k, width - k)
        x = np.minimum(x[: max(0, len(x) - step)], x[step:])
        k += step
    return x


def anchors(data: np.ndarray, ends: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash) for each run of windows that share an anchor: their first and last start in data, whose texts end at ends.

    Equal windows have equal hashes wherever they stand. A run may be cut in two, never joined with another.
    """
    begins, usable = np.concatenate([[0], ends[:-1]]), np.zeros(len(data) + 1, np.int8)
    long = ends - begins >= match
    usable[begins[long]] = 1
    usable[ends[long] - match + 1] = -1
    usable = np.cumsum(usable, dtype=np.int8).view(bool)
    parts = []
    for a in range(0, len(data) - match + 1, SLICE):
        piece = data[a : a + SLICE + match - 1]
        h = identifiers(piece, min(ANCHOR, match))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        at = (_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), match - min(ANCHOR, match) + 1) & _LOW).astype(np.int64)
        on = np.flatnonzero(usable[a : a + len(at)])
        if len(on):
            at = at[on]
            turns = np.flatnonzero(at[1:] != at[:-1]) + 1
            first, last = np.concatenate([[0], turns]), np.concatenate([turns, [len(at)]]) - 1
            parts.append((a + on[first], a + on[last], h[at[first]]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changes = np.zeros(len(sorted_keys[0]), bool)
    changes[:1] = True
    for key in sorted_keys:
        changes[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changes)


def refine(data: np.ndarray, at: np.ndarray, order: np.ndarray, match: int) -> np.ndarray:
    """For each window (its start in data, ascending, and its document's place in the order of documents): the smallest place of
    any equal one.

    Buckets are sorted by identifiers of at most 32 bytes, then by those of a later offset; one that holds a single document goes.
    """
    least = order.copy()
    if not len(at):
        return least
    half = min(32, match) if match <= 64 else (match + 1) // 2
    alive, buckets = np.arange(len(at)), np.zeros(len(at), np.int64)
    for offset in sorted({0, match - half}):
        keys = identifiers_at(data, at + offset, half)[alive]
        sort = np.lexsort((keys, buckets)) if offset else np.argsort(keys, kind="stable")
        alive, keys, buckets = alive[sort], keys[sort], buckets[sort]
        heads = _runs(buckets, keys)
        sizes = np.diff(np.append(heads, len(alive)))
        low = np.minimum.reduceat(order[alive], heads)
        mixed = low < np.maximum.reduceat(order[alive], heads)
        kept = np.repeat(mixed, sizes)
        alive, buckets, low = alive[kept], np.repeat(np.arange(int(mixed.sum())), sizes[mixed]), low[mixed]
        if not len(alive):
            return least
    heads = _runs(buckets)
    unlike = _differ(data, at[alive], at[alive[heads]][buckets], match)
    least[alive] = low[buckets]
    if unlike.any():  # identifiers that met by chance: such buckets are told apart by their bytes
        again = alive[np.isin(buckets, buckets[unlike])]
        texts = np.stack([data[i : i + match] for i in at[again]])
        _, which = np.unique(texts, axis=0, return_inverse=True)
        lows = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lows, which.ravel(), order[again])
        least[again] = lows[which.ravel()]
    return least


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, match: int) -> np.ndarray:
    """Whether the windows at a and at b differ in any byte, eight bytes at a time."""
    if match < 8:
        return (data[a[:, None] + np.arange(match)] != data[b[:, None] + np.arange(match)]).any(1)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.zeros(len(a), bool)
    for offset in {*range(0, match - 7, 8), match - 8}:
        out |= words[a + offset] != words[b + offset]
    return out


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for each length, one after another."""
    return np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and where each row begins, and the last ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)), offsets


def _grouped(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in groups of bounded bytes, with their texts' bytes and ends."""
    data, offsets = _texts(batch.column(text))
    a = 0
    while a < len(batch):
        b = min(len(batch), a + 50_000, max(a + 1, int(np.searchsorted(offsets, offsets[a] + GROUP_BYTES, "right")) - 1))
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        a = b


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of consecutive elements of data, so many each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _places(keys: np.ndarray) -> np.ndarray:
    """Documents' places in the order of ids: the first eight bytes of their keys."""
    return np.ascontiguousarray(keys[:, :8]).view(">i8").ravel().astype(np.int64)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have this width."""
    data, offsets = _texts(column)
    return data[offsets[0] : offsets[-1]].reshape(-1, width)


def _by_doc(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values sorted by document, the documents, and how many each has."""
    sort = np.argsort(docs, kind="stable")
    heads = _runs(docs[sort])
    return values[sort], docs[sort][heads], np.diff(np.append(heads, len(sort)))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of both rounds: a bucket, whether they are answers already, a table of documents, and a body."""
    bucket, answer, docs, body = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(answer, pa.bool_()), pa.array(docs, pa.binary()), pa.array(body, pa.binary())], names=["bucket", "answer", "docs", "body"])


_PACKED = "bucket long, answer boolean, docs binary, body binary"


def _answers(keys: np.ndarray, docs: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """A table of documents with the number of each one's values, and the values."""
    values, docs, counts = _by_doc(docs, values)
    table = np.concatenate([keys[docs], counts.astype("<u8").view(np.uint8).reshape(-1, 8)], axis=1)
    return table.tobytes(), np.ascontiguousarray(values).tobytes()


def _told(rows: list[tuple[bytes, bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Answers of many rows, as (k, values of 8 bytes, how many each)."""
    table = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 24)
    counts = np.ascontiguousarray(table[:, 16:]).view("<u8").ravel().astype(np.int64)
    return _binary(np.ascontiguousarray(table[:, :16]).ravel(), np.full(len(table), 16)), np.frombuffer(b"".join(r[1] for r in rows), "<u8"), counts


#: Before ids of 8 bytes; others are of 4 bytes, the bucket before them.
_WIDE = np.array([0xFFFFFFFF], "<u4")


def _listed(parts: list[bytes]) -> np.ndarray:
    """Anchors' numbers in what a document was told."""
    out = [np.zeros(0, np.uint64)]
    for part in parts:
        words = np.frombuffer(part, "<u4")
        out.append(np.frombuffer(part, "<u8", offset=4) if words[0] == _WIDE[0] else words[1:].astype(np.uint64) | np.uint64(int(words[0]) << 32))
    return np.concatenate(out)


def _headed(heads: np.ndarray, values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values: a head of 4 bytes and then so many of the consecutive values each."""
    width = values.itemsize // 4
    out = np.zeros(len(counts) + len(values) * width, "<u4")
    at = np.cumsum(counts * width + 1) - counts * width - 1
    out[at] = heads
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[rest] = values.view("<u4")
    return _binary(out, counts * width + 1)


def _numbers(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors' numbers: the bucket of the first round above 32 bits of the hash."""
    g = _mixed(hashes)
    return ((g >> np.uint64(32)) * np.uint64(buckets)) & ~np.uint64(0xFFFFFFFF) | g & np.uint64(0xFFFFFFFF)


_ENTRY = np.dtype([("g", "<u4"), ("doc", "<u2"), ("docs", "<u2")])
_REGION = np.dtype([("doc", "<u2"), ("length", "<u2"), ("start", "<u4")])


def shared_anchors(docs: DataFrame, match: int, buckets: int, hot: int) -> DataFrame:
    """(k, ids, hot) for docs (k, text): numbers of each document's anchors that another one has (see _listed), and, without
    a k, of those that more than `hot` have (8 bytes each). A document may have several rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in _grouped(batch, 1):
                first, _, hashes = anchors(data, ends, match)
                if not len(first):
                    continue
                keys, doc = _fixed(rows.column(0), 16), np.searchsorted(ends, first, "right")
                ids = _numbers(hashes, buckets)
                sort = np.argsort(ids, kind="stable")
                ids, doc = ids[sort], doc[sort]
                each = _runs(ids, doc)  # a document's anchors once
                ids, doc = ids[each], doc[each]
                heads = _runs(ids)
                counts = np.diff(np.append(heads, len(ids)))
                out = []
                both = np.repeat(counts > 1, counts)
                if both.any():  # known here already
                    table, body = _answers(keys, doc[both], ids[both])
                    out.append((int(ids[0] >> np.uint64(16)) % buckets, True, table, body))
                sent = np.zeros(len(heads), _ENTRY)
                bucket, doc = (ids[heads] >> np.uint64(32)).astype(np.int64), doc[heads]
                sent["g"], sent["docs"] = ids[heads] & np.uint64(0xFFFFFFFF), np.minimum(counts, 65_535)
                sort = np.lexsort((doc, bucket))
                sent, doc, bucket = sent[sort], doc[sort], bucket[sort]
                for a, b in pairwise([*_runs(bucket), len(bucket)]):
                    held = _runs(doc[a:b])
                    sent["doc"][a:b] = np.repeat(np.arange(len(held)), np.diff(np.append(held, b - a)))
                    out.append((int(bucket[a]), False, keys[doc[a:b][held]].tobytes(), sent[a:b].tobytes()))
                yield _packed(out)

    def meet(table: pa.Table) -> pa.Table:
        told, bodies, keys, sizes, bucket = [], [], [], [], 0
        for bucket, answer, docs_, body in zip(*[c.to_pylist() for c in table.columns], strict=True):
            if answer:
                told.append((docs_, body))
            else:
                bodies.append(np.frombuffer(body, _ENTRY))
                keys.append(np.frombuffer(docs_, np.uint8).reshape(-1, 16))
        out = []
        if told:
            k, ids, n = _told(told)
            out.append(pa.table({"k": k, "ids": _headed(_WIDE, ids, n), "hot": pa.array(np.zeros(len(k), bool))}))
        if bodies:
            sizes = np.cumsum([0, *[len(x) for x in keys[:-1]]])
            all_, keys = np.concatenate(bodies), np.concatenate(keys)
            doc = all_["doc"].astype(np.int64) + np.repeat(sizes, [len(x) for x in bodies])
            sort = np.argsort(all_["g"], kind="stable")
            g, doc, many = all_["g"][sort], doc[sort], all_["docs"][sort].astype(np.int64)
            heads = _runs(g)
            counts, total = np.diff(np.append(heads, len(g))), np.add.reduceat(many, heads)
            high = np.uint64(bucket << 32)
            # A row that speaks for several documents has told them.
            ask = np.repeat(counts > 1, counts) & (many == 1)
            if ask.any():
                ids, held, n = _by_doc(doc[ask], g[ask])
                out.append(pa.table({"k": _binary(keys[held].ravel(), np.full(len(held), 16)), "ids": _headed(np.array([bucket], "<u4"), ids, n), "hot": pa.array(np.zeros(len(held), bool))}))
            common = g[heads[total > hot]].astype(np.uint64) | high
            if len(common):
                out.append(pa.table({"k": pa.array([None], pa.binary()), "ids": _binary(common, np.array([len(common)])), "hot": pa.array([True])}))
        return pa.concat_tables(out) if out else pa.table({"k": pa.array([], pa.binary()), "ids": pa.array([], pa.binary()), "hot": pa.array([], pa.bool_())})

    return docs.mapInArrow(send, _PACKED).groupBy("bucket").applyInArrow(meet, "k binary, ids binary, hot boolean")


def _spans(windows: np.ndarray, of: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive window starts (ascending), as (begin, end) of what they cover, and each run's `of`. The windows of two
    texts are never consecutive: a text's last bytes open none."""
    heads = np.flatnonzero(np.append(True, windows[1:] != windows[:-1] + 1))
    return np.stack([windows[heads], windows[np.append(heads[1:], len(windows)) - 1] + match], axis=1), of[heads]


def _pairs(spans: np.ndarray) -> np.ndarray:
    """(begin, end) in eight bytes."""
    return np.ascontiguousarray(spans, "<u4").view("<u8").ravel()


def repeated(docs: DataFrame, known: DataFrame, match: int, buckets: int, anchor_buckets: int, hot: np.ndarray) -> DataFrame:
    """(k, spans) of docs (k, id, text): what is to be removed, as begins and ends of 4 bytes each. known: (k, ids) as arrays."""
    common = docs.sparkSession.sparkContext.broadcast(hot)  # ANCHORS_HOT numbers at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = common.value
        for batch in batches:
            at = 0
            for rows, data, ends in _grouped(batch, 2):
                first, last, hashes = anchors(data, ends, match)
                if not len(first):
                    continue
                keys, begins = _fixed(rows.column(0), 16), np.concatenate([[0], ends[:-1]])
                places = _places(keys)
                doc, ids = np.searchsorted(ends, first, "right"), _numbers(hashes, anchor_buckets)
                cuts = np.searchsorted(doc, np.arange(len(ends) + 1))
                wanted = np.zeros(len(ids), bool)
                for d, listed in enumerate(rows.column(3).to_pylist()):
                    a, b = cuts[d], cuts[d + 1]
                    wanted[a:b] = np.isin(ids[a:b], _listed(listed))
                first, last, doc, ids = first[wanted], last[wanted], doc[wanted], ids[wanted]
                hit = hot[np.minimum(np.searchsorted(hot, ids), len(hot) - 1)] == ids if len(hot) else np.zeros(len(ids), bool)
                # Whole documents at a time; a document that is a part by itself has nothing to be compared with here.
                upto = np.cumsum(np.bincount(doc, last - first + 1, len(ends)))
                part = (np.concatenate([[0], upto[:-1]]) // PART_WINDOWS)[doc]
                out: list[tuple] = []
                for a, b in pairwise([*_runs(part), len(part)] if len(part) else []):
                    anchor = np.repeat(np.arange(a, b), last[a:b] - first[a:b] + 1)
                    windows = _ranges(first[a:b], last[a:b] - first[a:b] + 1)
                    if doc[a] != doc[b - 1]:
                        gone = refine(data, windows, places[doc[anchor]], match) < places[doc[anchor]]
                        if gone.any():
                            spans, of = _spans(windows[gone], doc[anchor[gone]], match)
                            out.append((at, True, *_answers(keys, of, _pairs(spans - begins[of][:, None]))))
                            windows, anchor = windows[~gone], anchor[~gone]
                    lone = hit[anchor]
                    bucket = (_mixed(identifiers_at(data, windows[lone], match)) % np.uint64(buckets)).astype(np.int64)
                    out += _regions(data, keys, begins, windows[lone], np.full(int(lone.sum()), match), doc[anchor[lone]], bucket)
                    windows, anchor = windows[~lone], anchor[~lone]
                    if len(windows):
                        heads = np.flatnonzero(np.append(True, (windows[1:] != windows[:-1] + 1) | (anchor[1:] != anchor[:-1])))
                        bucket = (_mixed(ids[anchor[heads]]) % np.uint64(buckets)).astype(np.int64)
                        out += _regions(data, keys, begins, windows[heads], np.diff(np.append(heads, len(windows))) + match - 1, doc[anchor[heads]], bucket)
                at += 1
                yield _packed(out)

    def meet(packed: pa.Table) -> pa.Table:
        told, texts, regions, tables = [], [], [], []
        for _, answer, docs_, body in zip(*[c.to_pylist() for c in packed.columns], strict=True):
            if answer:
                told.append((docs_, body))
            else:
                n, listed, size = np.frombuffer(body[:12], "<u4").tolist()
                raw = np.frombuffer(pa.decompress(body[12:], 16 * n + 8 * listed + size, codec="zstd"), np.uint8)
                tables.append(np.ascontiguousarray(raw[: 16 * n].reshape(16, n).T))
                regions.append(np.ascontiguousarray(raw[16 * n : 16 * n + 8 * listed]).view(_REGION))
                texts.append(raw[16 * n + 8 * listed :])
        if texts:
            data, all_, table = np.concatenate(texts), np.concatenate(regions), np.concatenate(tables)
            doc = all_["doc"].astype(np.int64) + np.repeat(np.cumsum([0, *[len(t) for t in tables[:-1]]]), [len(r) for r in regions])
            lengths = all_["length"].astype(np.int64)
            begins, n = np.cumsum(lengths) - lengths, lengths - match + 1
            windows, region = _ranges(begins, n), np.repeat(np.arange(len(n)), n)
            places = _places(table)[doc][region]
            gone = refine(data, windows, places, match) < places
            if gone.any():
                spans, of = _spans(windows[gone], region[gone], match)
                told.append(_answers(table, doc[of], _pairs(spans - (begins[of] - all_["start"][of].astype(np.int64))[:, None])))
        k, spans, n = _told(told)
        return pa.table({"k": k, "spans": _binary(spans, n)})

    # The columns that the last join takes too, so that Spark shuffles the texts once for both.
    rows = docs.join(known, "k").select("k", "id", "text", "ids")
    return rows.mapInArrow(send, _PACKED).groupBy("bucket").applyInArrow(meet, "k binary, spans binary")


def _regions(data: np.ndarray, keys: np.ndarray, begins: np.ndarray, first: np.ndarray, lengths: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """Rows with the texts of regions, one for each bucket: counts, then (compressed) documents' keys byte by byte, regions and texts."""
    sort = np.lexsort((doc, bucket))
    first, lengths, doc, bucket = first[sort], lengths[sort], doc[sort], bucket[sort]
    out = []
    for a, b in pairwise([*_runs(bucket), len(bucket)] if len(bucket) else []):
        held = _runs(doc[a:b])
        listed = np.zeros(b - a, _REGION)
        listed["doc"] = np.repeat(np.arange(len(held)), np.diff(np.append(held, b - a)))
        listed["length"], listed["start"] = lengths[a:b], first[a:b] - begins[doc[a:b]]
        text = data[_ranges(first[a:b], lengths[a:b])]
        body = keys[doc[a:b][held]].T.tobytes() + listed.tobytes() + text.tobytes()
        out.append((int(bucket[a]), False, b"", np.array([len(held), b - a, len(text)], "<u4").tobytes() + pa.compress(body, codec="zstd", asbytes=True)))
    return out


def remove_repeats(docs: DataFrame, match: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, n_bytes, spans array<struct<begin, end>>, kept binary) of every row of docs: maximal runs of bytes that are
    covered by strings of `match` bytes which start in a document with a smaller id too, and the other bytes, joined.

    Texts are UTF-8 bytes, so kept may end within a character. A null text is empty. Ids are whole numbers; a null id comes after
    all others. Rows with equal ids, repeated rows among them, are not smaller than each other. Texts shorter than match stay
    whole. Other columns are not read; an empty table gives an empty result.
    """
    if not 8 <= match <= 30_000:
        raise ValueError("match is to be of 8 to 30000 bytes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("place", F.coalesce("id", F.lit(2**63 - 1)))
    # Rows with one id and one text are one to all that follows: the key is the place of the id and a hash of the text.
    key = F.coalesce(F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("place", F.xxhash64("text"))]), F.lit(b""))  # never null, so that no join filters for it
    rows = rows.withColumn("k", key)
    keyed = rows.select("k", "id", F.col("text").cast("binary").alias("text"))
    slim = rows.select("k", "place", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same"), F.octet_length("text").alias("n"))
    copies = cut(slim.join(slim.groupBy("same").agg(F.min("place").alias("least")), "same").where("place > least").groupBy("k").agg(F.first("n").alias("n")))

    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, size // BUCKET_BYTES)
    found = cut(shared_anchors(keyed.select("k", "text"), match, buckets, max(HOT_DOCS, size // ANCHORS_HOT)))
    hot = np.unique(np.frombuffer(b"".join(r["ids"] for r in found.where("hot").select("ids").collect()), "<u8"))
    told = found.where("not hot").select("k", "ids")
    shared = (told.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 4
    known = told.join(copies, "k", "left_anti").groupBy("k").agg(F.collect_list("ids").alias("ids"))
    spans = repeated(keyed, known, match, max(32, shared * (3 * match // 2) // TASK_BYTES), buckets, hot)
    # An empty span stands for the whole text.
    spans = spans.unionByName(copies.where(F.col("n") >= match).select("k", F.lit(b"").alias("spans"))).groupBy("k").agg(F.collect_list("spans").alias("spans"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in _grouped(batch, 1):
                listed, kept, n = [], [], np.diff(np.concatenate([[0], ends]))
                for begin, end, parts in zip((ends - n).tolist(), ends.tolist(), rows.column(2).to_pylist(), strict=True):
                    runs = [] if not parts else np.array([[0, end - begin]]) if b"" in parts else merged(np.frombuffer(b"".join(parts), "<u4").reshape(-1, 2).astype(np.int64))
                    stays = np.concatenate([[0], np.ravel(runs), [end - begin]]).astype(np.int64).reshape(-1, 2) + begin
                    listed.append([{"begin": int(a), "end": int(b)} for a, b in runs])
                    kept.append(b"".join(data[a:b].tobytes() for a, b in stays))
                yield pa.record_batch([rows.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    out = keyed.join(spans, "k", "left").select("id", "text", "spans").mapInArrow(drop, "id long, n_bytes long, spans array<struct<begin: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (begin, end) that overlap or touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    heads = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]], axis=1)
