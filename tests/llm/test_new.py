"""Importance resampling and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
from inkgrid.llm import prefix_trie, resample


def test_run_crcs_equal_those_of_the_strings():
    draw = random.Random(1)
    words = [bytes(draw.randrange(97, 123) for _ in range(draw.choice([1, 2, 5, 63, 64, 65, 300, 5000]))) for _ in range(200)]
    texts = np.sort(np.array([draw.randrange(20) for _ in words]))
    crcs, lengths = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words], np.int64)
    for n, (at, found) in enumerate(resample.run_crcs(crcs, lengths, texts, 4), 1):
        kept = [i for i in range(len(words) - n + 1) if texts[i] == texts[i + n - 1]]
        assert at.tolist() == [texts[i] for i in kept]
        assert found.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in kept]


def brute_resample(docs, target, percent=25, min_words=20, buckets=10_000):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [" ".join(p) for p in zip(w, w[1:])]]

    s, t = Counter(b for _, x in docs for b in feats(x)[1]), Counter(b for x in target for b in feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, f = feats(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


def test_resampling_of_a_whole_table(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    found = __spark_entry__.queries()["op12_importance_resampling"](spark, data)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == brute_resample(docs, target)


def test_resampling_of_odd_rows(spark):
    draw = random.Random(2)
    vocabulary = ["Été", "naïve", "x1", "ZWÖLF", "日本", "a" * 200, "the", "and", "İ"]
    text = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", ",", "\n", "\x00", "_"]) for _ in range(n))
    rows = [(i, text(draw.choice([0, 1, 19, 20, 21, 60])), 1.0, "k") for i in range(60)] + [(60, None, 0.0, None), (None, text(30), 0.0, None), (7, text(20), 0.0, None), (61, text(20_000), 0.0, None), (62, "a" * 1_000_000, 0.0, None)]
    rows += [rows[21]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, rank string").repartition(5)
    targets = [("the and the and x1",), (None,), ("",)]
    found = resample.resample(docs, spark.createDataFrame(targets, "text string")).collect()
    assert Counter(map(tuple, found)) == brute_resample([r[:2] for r in rows], [t[0] for t in targets])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).collect() == []
    assert Counter(map(tuple, resample.resample(docs, none).collect())) == brute_resample([r[:2] for r in rows], [])


def brute_trie(rows):
    own: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, head = zlib.crc32(str(c).encode()) % 9, own.get(c - int(math.fmod(c, 5)), [])
        built[c] = head[:h] + turns[h:]
    nodes: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out[min(members), len(path)] = (min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_of(spark, rows, part_turns=prefix_trie.PART_TURNS):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS seq").repartition(3)
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(turns)), part_turns).collect()
    assert len({(r["conv_id"], r["depth"]) for r in found}) == len(found)
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found}


@pytest.mark.parametrize("part_turns", [prefix_trie.PART_TURNS, 12, 1])
def test_trie_of_shared_openings_in_parts_of_any_size(spark, part_turns):
    draw = random.Random(4)
    rows = []
    for c in range(-7, 120):
        opening = draw.choice([["hi"], ["hi", "hé"], ["hi", "hé", "how"], ["yo"], []])
        turns = opening + [draw.choice(["a", "b", "ccc"]) for _ in range(draw.randrange(9))]
        rows += [(c, k, draw.choice(["u", None]) if k > 2 else "u", t) for k, t in enumerate(turns)]
    rows += [(200, t, "u", x) for t, x in [(None, "late"), (1, "b"), (1, "a"), (1, None), (1, "a"), (None, None), (3, "é")]]
    rows += [(None, 0, "u", "lost"), (1_000_003, 0, "u", "alone"), (9_007_199_254_740_993, 0, "u", "hi"), (500, 0, None, None)]
    assert trie_of(spark, rows, part_turns) == brute_trie(rows)


def test_trie_of_empty_and_turnless_tables(spark):
    assert trie_of(spark, []) == {}
    turnless = [c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1 and c - c % 5 > 300]
    rows = [(c, 0, "u", "x") for c in turnless]  # heads are absent, so that all of each conversation's turns go
    assert turnless and trie_of(spark, rows) == brute_trie(rows)
    assert [k[1] for k in trie_of(spark, rows)] == [0]


def test_trie_of_copies_and_a_long_conversation(spark):
    rows = [(c, k, "u", f"turn {k}") for c in range(0, 3000, 5) for k in range(3)] + [(7000, k, "u", f"t{k % 7}") for k in range(150)]
    found = trie_of(spark, rows, 50)
    assert found == brute_trie(rows)


def test_trie_of_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = __spark_entry__.queries()["op13_prefix_trie"](spark, data)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found.collect()} == brute_trie(rows)
