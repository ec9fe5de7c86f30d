"""Operators on pairs of texts, URLs and messages, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from inkgrid.llm import components, decontaminate, queries, quotes, simhash_dedup, url_filter
from tests.compare import rows_of_duck, rows_of_spark


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{id: smallest id that is reachable}, by comparing all pairs."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_equals_brute_force():
    for text in (None, "", " \n", "One", "one two", "A b c d", "A b c d a b c d é ß", "x " * 50):
        assert simhash_dedup.fingerprint(text, 3) == brute_fingerprint(text)


def test_near_duplicates_equal_brute_force(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    expected = brute_components({i: brute_fingerprint(t) for i, t in docs.items()})
    for r in queries.op3_simhash_dedup(spark, data).collect():
        assert (int(r["fingerprint"], 16), r["component_id"]) == (brute_fingerprint(docs[r["doc_id"]]), expected[r["doc_id"]])


@pytest.mark.parametrize("limit", [1024, 4])
def test_long_lists_lose_no_link(spark, monkeypatch, limit):
    """Clusters of fingerprints some bits apart, with lists that are worked off at once or dealt again."""
    monkeypatch.setattr(simhash_dedup, "LIST_LIMIT", limit)
    r = random.Random(1)
    prints = {}
    for c in range(6):
        centre = r.getrandbits(64)
        for k in range(60):
            prints[len(prints)] = centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4])))
    df = spark.createDataFrame([(i, simhash_dedup._signed(p)) for i, p in prints.items()], "doc_id long, fp long")
    found = {simhash_dedup._signed(prints[i]): i for i in prints}
    expected = brute_components(prints)
    got = {row["fp"]: row["component_id"] for row in simhash_dedup.link(df).collect()}
    assert {i: got[simhash_dedup._signed(p)] for i, p in prints.items()} == expected and found


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, 1), (3, "", 1), (9, "some text here", 1), (9, "some text here", 2), (None, "some text here", 3), (7, "  ", 4)], "doc_id long, text string, fp int")
    found = Counter((r["doc_id"], r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect())
    assert found == {(5, 3): 1, (3, 3): 1, (7, 3): 1, (9, 9): 2, (None, None): 1}
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299), (299, 300)]
    found = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {300: 299}


def test_components_of_more_edges_than_a_task_joins_up(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 8)
    draw = random.Random(5)
    chain = draw.sample(range(400), 200)  # whose vertices follow one another in no order
    edges = [*zip(chain, chain[1:], strict=False), *((1000, 1001 + i) for i in range(150)), *((2000 + draw.randrange(60), 2000 + draw.randrange(60)) for _ in range(40)), (1, None), (None, None)]
    known = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    root = {x: x for e in known for x in e}
    for _ in root:
        for a, b in known:
            root[a] = root[b] = min(root[a], root[b])
    rows = spark.createDataFrame(edges, "u long, v long").repartition(7)
    found = [(r["vertex"], r["root"]) for r in components.components(rows).collect()]
    assert sorted(found) == sorted((x, r) for x, r in root.items() if x != r)


def test_components_of_few_edges_take_few_tasks(spark):
    """A small graph in many partitions is no round of many tasks, each of which leaves files and events."""
    many, context = 40, spark.sparkContext
    held = {"spark.sql.shuffle.partitions": str(many), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    edges = spark.range(0, 600, 1, many).selectExpr("id AS u", "id - id % 20 + (id + 1) % 20 AS v")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few-edges", "")
        found = components.components(edges)
        seen = context.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup("few-edges") for s in seen.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := seen.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["vertex"], r["root"]) for r in found.collect()} == {(i, i - i % 20) for i in range(600) if i % 20}
    assert many <= tasks <= 8 * many


def brute_leaks(texts, items, least=0.8):
    """Pairs whose best item-sized window, of all windows, is similar enough."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    found = {}
    for d, t in texts.items():
        w = words(t)
        every = shingles(w)
        for k, item in items.items():
            v = words(item)
            own = shingles(v)
            best = 0
            if not (w and v) or own.keys().isdisjoint(every):
                continue  # no window has anything in common
            for s in range(max(1, len(w) - len(v) + 1)):
                window = shingles(w[s : s + len(v)])
                common = (own & window).total()
                best = max(best, common / (own.total() + window.total() - common))
            if best >= least:
                found[d, k] = best
    return found


def test_leaks_equal_brute_force(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op4_decontamination(spark, data).collect()}
    assert found == pytest.approx(brute_leaks(docs, items)) and found


def test_edited_leaks_are_found(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = {k: " ".join(word() for _ in range(r.randint(30, 57))) for k in range(30)} | {90: "three short words", 91: "", 92: None}
    docs = {}
    for k, item in items.items():
        w = (item or "").split()
        if len(w) > 20:
            at = r.choice([1, 2, len(w) - 2])
            edited = w[:at] + [word()] * r.randint(0, 1) + w[at + r.randint(0, 1) :]
            docs[k] = " ".join([word() for _ in range(40)] + edited + [word() for _ in range(40)])
            docs[100 + k] = "Intro: " + ",\n".join(w).upper() + "!"
    docs |= {200: None, 201: "", 202: "say Three, short WORDS again", 203: "clean text of many words that no item holds"}
    found = decontaminate.find_leaks(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string"))
    got, expected = {(x["doc_id"], x["item_id"]): x["similarity"] for x in found.collect()}, brute_leaks(docs, {k: v for k, v in items.items() if k < 90})
    assert {k: v for k, v in got.items() if k[1] < 90} == pytest.approx(expected) and len(expected) > 40
    assert (202, 90) in got and all(d != 203 for d, _ in got)
    args = spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")
    assert sorted(map(str, found.collect())) == sorted(map(str, decontaminate.find_leaks(*args, broadcast_bytes=0).collect()))  # items too many to broadcast
    shared = args[0].withColumn("doc_id", F.col("doc_id") % 7)  # rows that share an id
    assert sorted(map(str, decontaminate.find_leaks(shared, args[1]).collect())) == sorted(map(str, decontaminate.find_leaks(shared, args[1], broadcast_bytes=0).collect()))
    long_text = "lead " * 200_000 + items[0] + " tail" * 200_000
    assert decontaminate.find_leaks(spark.createDataFrame([(1, long_text)], "doc_id long, text string"), args[1]).count() == 1


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == decontaminate.find_leaks(docs.limit(0), items).count() == 0
    clash = docs.withColumn("item_id", F.lit(1)).withColumn("words", F.lit("x"))
    assert decontaminate.drop_leaks(clash, items).count() == 0 and decontaminate.drop_leaks(clash, items).columns == clash.columns
    odd = spark.createDataFrame([(None, "a b c d e f g", 1), (None, "something else altogether", 2), (5, "A b c, d e f g", 3), (5, "clean", 4), (5, "clean", 4), (6, None, 5)], "doc_id long, text string, _leak long")
    assert sorted(r["_leak"] for r in decontaminate.drop_leaks(odd, items).collect()) == [2, 4, 4, 5]
    string_ids = docs.withColumn("doc_id", F.lit("x1"))
    assert [r["doc_id"] for r in decontaminate.find_leaks(string_ids, items).collect()] == ["x1"]


def test_urls_equal_sql_and_odd_urls(spark, data, duck):
    assert rows_of_spark(queries.op6_url_filter(spark, data)) == rows_of_duck(duck.sql(queries.ORACLE["op6_url_filter"]))
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://example.com", "http://notexample.com/en/", "x://a.net/es/1", "x://a.net/ES/1", "ftp://net/fr/", "http://a.org/best-casino/#x", "http://a.org/casinos", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "http://a.com/", "h", "r")] * 2, "page_id long, url string, host string, rule string")
    found = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).orderBy("page_id").collect()]
    assert found == [
        (None, "a.com", "/", "com/", "allow"), (None, "a.com", "/", "com/", "allow"), (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"),
        (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "example.com", "/en/", "example.com/en/", "block"), (5, "example.com", "", None, "allow"), (6, "notexample.com", "/en/", "com/", "allow"),
        (7, "a.net", "/es/1", "net/es/", "block"), (8, "a.net", "/ES/1", None, "allow"), (9, "net", "/fr/", "net/fr/", "block"), (10, "a.org", "/best-casino/", None, "block"), (11, "a.org", "/casinos", None, "allow"), (12, "b:", "//c/d", None, "allow"),
    ]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0 and url_filter.filter_urls(pages, []).count() == len(urls) + 2


TALK = [
    (1, 0, "user", "What is the plan for tomorrow?\nWe meet at noon."),
    (1, 1, "assistant", "> What is the plan for tomorrow?\n\nLunch first."),
    (1, 2, "user", "Anything else to discuss today?"),
    (1, 3, "assistant", "On Monday, A wrote:\n> Lunch first.\n>> What is the plan for tomorrow?\nGood idea."),
    (1, 4, "user", "> we MEET at noon!\nFine."),
    (2, 0, "user", "Lunch first."),
    (2, 1, None, None),
    (None, 5, "user", "> Lunch first.\nhm"),
    (3, 0, "user", "> never said\nok"),
]


def test_quotes_are_linked_and_taken_out(spark):
    messages = spark.createDataFrame([(*m, "x") for m in TALK], "conv_id long, turn long, role string, text string, body string")
    found = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(messages).collect()}
    assert len(found) == len(TALK)
    assert {k[1]: (r["reply_to"], r["thread"]) for k, r in found.items() if k[0] == 1} == {0: (None, 0), 1: (0, 0), 2: (None, 2), 3: (1, 0), 4: (0, 0)}
    assert found[1, 3]["body"] == "Good idea." and found[1, 3]["max_level"] == 2 and found[1, 3]["n_quotes"] == 2
    assert found[3, 0]["reply_to"] is None and found[None, 5]["reply_to"] is None and found[2, 1]["body"] == ""
    order = [(r["conv_id"], r["turn"]) for r in quotes.chat(quotes.link_quotes(messages.where("conv_id = 1"))).collect()]
    assert order == [(1, 0), (1, 1), (1, 3), (1, 4), (1, 2)]
    assert quotes.link_quotes(messages.limit(0)).count() == 0


def test_chains_of_replies(spark):
    chain = [(1, 0, "u", "message number zero")] + [(1, i, "u", f"> message number {'zero' if i == 1 else 'x' * (i - 1)}\nmessage number {'x' * i}") for i in range(1, 12)]
    found = quotes.link_quotes(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()
    assert {r["thread"] for r in found} == {0} and {r["turn"]: r["reply_to"] for r in found} == {0: None} | {i: i - 1 for i in range(1, 12)}


def test_conversations_without_quotes_stay_as_they_are(spark, data):
    talk = spark.read.parquet(f"{data}/conversations.parquet")
    found = queries.op5_quotation_linking(spark, data)
    assert found.count() == talk.count()
    texts = {(r["conv_id"], r["turn"]): r["text"] or "" for r in talk.collect()}
    plain = [r for r in found.collect() if not r["n_quotes"]]
    assert len(plain) > 50 and all(r["body"] == texts[r["conv_id"], r["turn"]].strip("\n") and r["reply_to"] is None for r in plain)


def test_threads_equal_the_trees_they_were_made_from(spark):
    """Messages that quote their parent and, a level deeper, what it quoted; the order is the trees' own, branch by branch."""
    draw = random.Random(7)
    rows, parent, own = [], {}, {}
    for conv in range(6):
        for turn in range(40):
            own[conv, turn] = " ".join(f"w{draw.randrange(10**9)}" for _ in range(draw.randint(3, 9))) + "."
            up = draw.choice([None, *range(turn)]) if turn else None
            parent[conv, turn] = up
            quoted = [] if up is None else ["> " + own[conv, up].upper()] + ([] if parent[conv, up] is None else [">> " + own[conv, parent[conv, up]]])
            rows.append((conv, turn, "u", "\n".join([*quoted, own[conv, turn]])))
    found = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["reply_to"] for k, r in found.items()} == parent
    thread, branch = {}, {}
    for (c, t), up in parent.items():  # parents come first
        thread[c, t] = t if up is None else thread[c, up]
        oldest = up is not None and min(k for (d, k), p in parent.items() if d == c and p == up) == t
        branch[c, t] = branch[c, up] if oldest else t
    assert {k: (r["thread"], r["branch"]) for k, r in found.items()} == {k: (thread[k], branch[k]) for k in parent}
    order = sorted(found, key=lambda k: found[k]["position"])
    assert order == sorted(parent, key=lambda k: (k[0], thread[k], branch[k], k[1]))
    assert all(found[k]["part"] == f"<|u|>\n{own[k]}\n" for k in parent)
    repeated = quotes.link_quotes(spark.createDataFrame(rows + rows[:50], "conv_id long, turn long, role string, text string")).collect()
    assert len(repeated) == len(rows) + 50 and {(r["conv_id"], r["turn"]): r["reply_to"] for r in repeated} == parent
    long_text = "> " + "word " * 100_000 + "\n" + "more " * 100_000
    assert quotes.link_quotes(spark.createDataFrame([(1, 1, "u", long_text)], "conv_id long, turn long, role string, text string")).first()["n_quotes"] == 1


NESTED = [
    (1, 0, "Could we please move the long planning meeting to Thursday afternoon next week?"),
    (1, 1, "> Could we please move the long planning meeting to Thursday afternoon next week?\nThursday works."),
    (1, 2, ">> Could we please move the long planning meeting to Thursday afternoon next week?\n> Thursday works.\nBooked."),
    (1, 3, ">> Thursday works.\nOnly the deeper quote is known."),
    (2, 0, "First paragraph is here. It has two\nsentences.\n\nThe second one is\nsplit otherwise.\n\nThe third is left out."),
    (2, 1, "Something else."),
    (2, 2, "> First paragraph\n> is here. It has two sentences.\n>\n> The second one\n> is split otherwise.\nAgreed."),
    (2, 3, "> It has\n> two sentences.\nTwo?"),
    (3, 0, "a b c.\nd e f."), (3, 1, "g h i j k"), (3, 2, "> a b c.\n> x\n> g h i j k\nno"),
]


def test_parent_is_quoted_at_the_lowest_level_and_however_wrapped(spark):
    rows = [(c, t, "u", x) for c, t, x in NESTED]
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): r["reply_to"] for r in found} == {
        (1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (2, 0): None, (2, 1): None, (2, 2): 0, (2, 3): 0, (3, 0): None, (3, 1): None, (3, 2): 1,
    }


def test_ids_of_any_ordered_type(spark):
    texts = {"b": "one two three four", "a": "one two three four", "c": "five six seven eight nine", "é": None, "d": "", "": "five six seven eight nine"}
    rows = [*texts.items(), (None, "one two three four")]
    found = simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {"a": "a", "b": "a", "c": "", "": "", "d": "d", "é": "d", None: None}
