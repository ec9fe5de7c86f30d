"""The pipeline's stages against brute-force versions of each, on their own inputs."""

import public_tokenizers

import corpus_pipeline
from inkgrid.llm import quality, token_counts
from tests.llm.test_pairs import brute_leaks
from tests.llm.test_similar import brute_groups
from tests.llm.test_texts import check_packing


def test_stages_equal_brute_force(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, data).write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        rows = docs.collect()
        seen[name] = len({r["doc_id"] for r in rows})
        if name == "quality rules":
            judged = {i: quality.judge(t) for i, t in before.items()}
            assert {r["doc_id"]: r["text"] for r in rows} == {i: j.clean_text for i, j in judged.items() if j.kept}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "SimHash near-dedup":
            groups = brute_groups(before)
            assert {r["doc_id"] for r in rows} == {i for i, c in groups.items() if i == c}
        elif name == "benchmark decontamination":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
            assert {r["doc_id"] for r in rows} == set(before) - {d for d, _ in brute_leaks(before, items)}
        elif name == "PII":
            changed = [r for r in rows if r["text"] != before[r["doc_id"]]]
            assert len(rows) == len(before) and 0 < len(changed) < len(rows)
            assert all(any(c in "0123456789@" for c in before[r["doc_id"]]) for r in changed)
        if name != "best-fit packing":
            assert docs.columns == columns
    check_packing(rows, before)
    assert list(seen.values()) == sorted(seen.values(), reverse=True)


def test_run_gives_the_last_stage(spark, data):
    df = corpus_pipeline.run(spark, data)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0


def test_stages_keep_columns_with_dots(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).withColumnRenamed("source", "a.b").withColumnRenamed("lang", "c.d.e")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, data).columns == docs.columns


def test_packing_leaves_little_in_the_workers(monkeypatch):
    """Workers stay for the stages of the next job: what the pipeline's packing remembers is bounded by its own number."""
    asked = []
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda *a, **k: asked.append(k))
    corpus_pipeline.best_fit_packing(None, None, "")
    assert asked[0]["cache_entries"] <= 100_000
    own = token_counts.PieceCache(public_tokenizers.path(corpus_pipeline.TOKENIZER), False, entries=1000)
    for k in range(40):
        own.fill([[f"w{i:05d}" for i in range(k * 200, k * 200 + 200)]])
        assert len(own.by_piece) <= 1200 and len(own.by_pretoken) <= 1200
