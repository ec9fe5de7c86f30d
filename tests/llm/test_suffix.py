"""Suffix dedup against brute force over all strings of 50 bytes."""

import hashlib
import random

import numpy as np
import pytest

import __spark_entry__
from inkgrid.llm import suffix_dedup


def brute(docs, match=50):
    """(id, bytes, removed, spans, kept) of each (id, text), sorted; a null id comes last."""
    rank = lambda i: (i is None, i or 0)
    least: dict = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, t in texts:
        for k in range(len(t) - match + 1):
            s = t[k : k + match]
            if s not in least or rank(i) < least[s]:
                least[s] = rank(i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - match + 1):
            if least[t[k : k + match]] < rank(i):
                gone[k : k + match] = b"\1" * match
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (rank(r[0]), *r[1:]))


def removed(frame, **settings):
    rows = suffix_dedup.remove_repeats(frame, **settings).collect()
    out = []
    for r in rows:
        assert all(a["end"] < b["begin"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
        out.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def passages(seed, n=80):
    draw = random.Random(seed)
    make = lambda k: "".join(draw.choice("abcdé ü.\n") for _ in range(k))
    shared = [make(draw.choice([45, 49, 50, 51, 80, 300])) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [draw.choice([make(draw.randrange(120)), draw.choice(shared), draw.choice(shared)[draw.randrange(30) :]]) for _ in range(draw.randrange(9))]
        rows.append((i * 3 - 20, "".join(parts), "x"))
    rows += [(5, "a" * 3000, "x"), (6, "ab" * 900, "x"), (7, "a" * 49, "x"), (8, "a" * 50, "x"), (2, "b" + "a" * 70, "x"), (9, None, "x"), (10, "", "x"), (None, rows[3][1], "x"), (None, shared[5] * 2, "x"), (rows[7][0], rows[7][1], "x"), (rows[7][0], rows[9][1], "x")]
    return rows + [rows[11]] * 3 + [(1000 + k, rows[12][1], "x") for k in range(20)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_DOCS, 0, 3])
def test_passages_copies_runs_and_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_DOCS", hot)
    rows = passages(hot)
    frame = spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(5)
    assert removed(frame) == brute([r[:2] for r in rows])


def test_other_lengths_and_an_empty_table(spark):
    rows = passages(9, 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(3)
    for match in (8, 24, 90):
        assert removed(frame, match=match) == brute([r[:2] for r in rows], match)
    assert removed(frame.where("false")) == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame, match=7)


def test_a_long_text_over_many_slices(spark):
    draw = random.Random(3)
    long = "".join(draw.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long[140_000:140_400]), (2, long), (3, long[65_500:65_600] + "!" + long[:60])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(frame) == brute(rows)


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(5)
    data = draw.integers(97, 100, 200_000).astype(np.uint8)
    data[150_000:150_200] = data[1000:1200]
    ends = np.array([70, 70, 119, 60_000, 200_000])
    first, last, hashes = suffix_dedup.anchors(data, ends, 50)
    begins = np.concatenate([[0], ends[:-1]])
    starts = np.concatenate([np.arange(b, e - 49) for b, e in zip(begins, ends, strict=True)])
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]).tolist() == starts.tolist()
    by = dict(zip(starts.tolist(), np.repeat(hashes, last - first + 1).tolist(), strict=True))
    assert all(by[1000 + k] == by[150_000 + k] for k in range(151))
    assert len(first) < len(starts) / 14


def test_identifiers_that_meet_by_chance_are_told_apart(monkeypatch):
    draw = np.random.default_rng(6)
    data = draw.integers(97, 99, 5000).astype(np.uint8)
    data[3000:3100] = data[100:200]
    at, order = np.arange(4951), np.arange(4951) // 500
    true = suffix_dedup.refine(data, at, order, 50)
    assert (true[3000:3051] == order[100:151]).all() and 51 <= (true != order).sum() < 60  # some bytes before and after may agree by chance
    weak = suffix_dedup.identifiers
    monkeypatch.setattr(suffix_dedup, "identifiers", lambda d, w: weak(d, w) % np.uint64(97))
    assert (suffix_dedup.refine(data, at, order, 50) == true).all()


def test_the_table(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = __spark_entry__.queries()["op11_suffix_dedup"](spark, data)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect())) == brute(docs)


def test_parts_of_few_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_WINDOWS", 500)
    rows = passages(21)
    frame = spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(2)
    assert removed(frame) == brute([r[:2] for r in rows])
