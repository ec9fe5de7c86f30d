"""Near-duplicates by similarity against brute force over all pairs."""

import random

import corpus_pipeline
from inkgrid.llm import similar_dedup
from tests.llm.test_pairs import brute_components, brute_fingerprint

SCHEMA = "doc_id long, text string, component_id string"


def brute_groups(texts, width=5, similarity=0.8):
    """Smallest id that each text reaches over close fingerprints and similar shingle sets."""
    root = brute_components({i: brute_fingerprint(t, width) for i, t in texts.items()})
    sets = {i: similar_dedup.shingles(t, width) for i, t in texts.items()}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and root[a] != root[b] and both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_chain_of_edits_nulls_and_clashing_names(spark):
    draw = random.Random(3)
    words = [draw.choice("abcdefgh") + str(draw.randrange(10_000)) for _ in range(300)]
    texts = {}
    for k in range(12):  # each differs from the one before in two places
        texts[k] = " ".join(words)
        for _ in range(2):
            words[draw.randrange(len(words))] = f"new{k}"
    texts |= {20: None, 21: "", 22: "one", 23: "one", 24: " ".join(str(draw.random()) for _ in range(80))}
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, texts[0], "x"), (3, texts[3], "x")]
    found = similar_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_groups(texts) | {None: None}
    assert {r["component_id"] for r in found if r["doc_id"] is not None and r["doc_id"] < 12} == {0}


def test_empty_table(spark):
    assert similar_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketches_share_bytes_as_texts_share_shingles(spark):
    one = " ".join(map(str, range(1000)))
    other = " ".join([*map(str, range(900)), *(f"x{k}" for k in range(100))])
    a, b = (similar_dedup.sketch(t, 5) for t in (one, other))
    rows = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    parts = [f"named_struct({', '.join(f'''{chr(39)}s{k}{chr(39)}, {c}[{k}]''' for k in range(8))}) AS {c}" for c in "ab"]
    shared = rows.selectExpr(*parts).select(similar_dedup._shared("a", "b")).first()[0]
    assert shared == int((a.view("uint8") == b.view("uint8")).sum()) and shared > similar_dedup.MIN_BYTES


def _texts_of_one_fingerprint():
    """Two texts with equal fingerprints, and a third that is similar to the second only."""
    base, tail = " ".join(f"w{k}" for k in range(41)), " ".join(f"t{k}" for k in range(12))
    repeated = " ".join([base] * 20)
    return repeated, f"{repeated} {tail}", f"{base} {tail}"


def test_every_text_of_a_fingerprint_is_compared(spark):
    one, other, like_other = _texts_of_one_fingerprint()
    assert brute_fingerprint(one, 5) == brute_fingerprint(other, 5)
    texts = {1: one, 2: other, 3: like_other}
    found = similar_dedup.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_groups(texts) == {1: 1, 2: 1, 3: 1}


def test_stage_keeps_one_row_of_each_group(spark):
    draw = random.Random(8)
    text = lambda: " ".join(f"{draw.choice('abc')}{draw.randrange(10_000)}" for _ in range(100))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t + " end"
    rows = [
        (None, a, 1), (None, near(a), 1),  # a group of null ids: one stays
        (None, b, 1), (7, near(b), 1),  # a null id gives way to another
        (5, c, 1), (5, c, 1), (5, c, 2),  # repeated rows: one stays
        (4, d, 1), (4, e, 1), (6, near(e), 1), (2, near(d), 1),  # one id with two texts: each in its own group
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == 5 and {x for x in found if x[0] is not None} == {(7, near(b)), (5, c), (4, e), (2, near(d))}
    assert [t for i, t in found if i is None][0] in (a, near(a))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def _edited(draw, words, edits):
    """words with so many of them changed, each to a word of its own."""
    made = list(words)
    for k in draw.sample(range(len(made)), edits):
        made[k] = f"e{draw.randrange(10**9)}"
    return made


def test_large_groups_around_and_just_below_the_similarity(spark):
    """A group whose copies differ in few or many places, some of them in the same, and one of texts just too different."""
    draw = random.Random(11)
    base = [f"b{draw.randrange(10**9)}" for _ in range(150)]
    texts = {k: " ".join(_edited(draw, base, draw.choice([0, 1, 2, 3, 4, 5, 6, 8]))) for k in range(300)}
    shared = _edited(draw, base, 6)
    texts |= {400 + k: " ".join(_edited(draw, shared, draw.choice([1, 2, 3]))) for k in range(60)}
    other = [f"o{draw.randrange(10**9)}" for _ in range(150)]
    texts |= {600 + k: " ".join(_edited(draw, other, 3)) for k in range(200)}  # most pairs are at 0.66: many are retained, few are similar
    expected = brute_groups(texts)
    found = similar_dedup.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert len({c for i, c in expected.items() if i >= 600}) > 20 and len({c for i, c in expected.items() if i < 300}) > 20


def _pages_of_a_template(draw, n):
    """Pages of 100 common and 100 own words, a similarity of a third; every twentieth has a near copy."""
    common = [f"c{k}" for k in range(100)]
    texts = {k: " ".join(common + [f"o{draw.randrange(10**9)}" for _ in range(100)]) for k in range(n)}
    return texts | {10_000 + k: " ".join(_edited(draw, texts[k].split(), 3)) for k in range(0, n, 20)}


def test_pages_of_a_template_do_not_meet_one_by_one(spark):
    """Shared shingles of the prefixes, and with them the rows that the join of far entries makes, grow with the pages, not with their square."""
    draw, met = random.Random(2), []
    for n in (200, 400):
        texts = _pages_of_a_template(draw, n)
        docs = spark.createDataFrame(list(texts.items()), "id long, text string")
        members = docs.selectExpr("id AS u", "true AS far", "id AS root")
        often = similar_dedup._rarest(members, docs, 5, 0.8).groupBy("e").count().collect()
        met.append(sum(r["count"] ** 2 for r in often))
        pairs = {(r["u"], r["v"]) for r in similar_dedup._far_pairs(members, docs, 5, 0.8).collect()}
        assert {(10_000 + k, k) for k in range(0, n, 20)} <= pairs and len(pairs) < n
    assert met[1] < 3 * met[0]


def test_long_lists_of_far_entries(spark, monkeypatch):
    """The prefix filter, with lists counted as long from three entries, against all pairs."""
    monkeypatch.setattr(similar_dedup, "MEET", 2)
    draw = random.Random(6)
    texts = _pages_of_a_template(draw, 160)
    base = [f"g{k}" for k in range(120)]
    texts |= {20_000 + k: " ".join(_edited(draw, base, draw.choice([1, 3, 5, 30]))) for k in range(60)}
    found = similar_dedup.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)).collect()
    expected = brute_groups(texts)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert all(expected[10_000 + k] == k for k in range(0, 160, 20))


def test_similar_pairs_are_all_found(spark, data):
    """Recall on real texts against brute force over all pairs: every pair of similarity 0.8 ends in one group."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    draw = random.Random(5)
    for i, t in list(docs.items()):
        words = (t or "").split(" ")
        if len(words) > 60:
            docs[10_000 + i] = " ".join(_edited(draw, words, max(1, len(words) // 60)))  # about 0.85
    expected = brute_groups(docs)
    found = similar_dedup.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in docs.items()], SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert sum(i >= 10_000 and c < 10_000 for i, c in expected.items()) > 50
