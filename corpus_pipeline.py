"""The training-data pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared folder and reads it back,
so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import decontaminate, packing, pii, quality, similar_dedup
from inkgrid.llm.common import cut, ensure_checkpoints, table, unused

#: Parameters of the stages.
TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Pieces of text whose tokens a worker remembers: it is kept for the stages of the next job, whose memory that takes.
CACHE_ENTRIES = 100_000
#: Words of a shingle and similarity of two documents' shingles for the near-duplicate stage.
DEDUP_WIDTH = 5
DEDUP_SIMILARITY = 0.8


def _quoted(docs: DataFrame) -> list[str]:
    """The columns of docs, whatever is in their names."""
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the counts or lose too much go as a whole, null and empty texts among them.
    Each row is judged by itself: null and repeated ids and repeated rows stay as they are."""
    return quality.clean(docs, chars_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, with the smallest id; a null id comes after all others. Every row is
    grouped by its own text, so of repeated rows one stays, and rows that share an id may each be in another group. Texts
    without words, null ones included, are one group."""
    row = unused(docs, "_row")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = keyed.select(F.col(row).alias("id"), "text")
    placed = similar_dedup.groups(rows, DEDUP_WIDTH, DEDUP_SIMILARITY).select(F.col("id").alias(row), "root").join(keyed.select(row, "doc_id"), row)
    first = placed.groupBy("root").agg(F.coalesce(F.min_by(row, "doc_id"), F.min(row)).alias(row))
    return keyed.join(first.select(row), row, "left_semi").select(_quoted(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their id; null and empty texts stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format; n_chars follows. Every row stays; a null text stays null."""
    listed = unused(docs, "_pii")
    found = pii.pseudonymise(docs, pii.session_key(spark), found_col=listed)
    return found.withColumn("n_chars", F.when(F.size(listed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(_quoted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, tokenised and packed, with the token ids of every piece. Every row is a document, whatever
    its id; a null text is the separator alone."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), CAPACITY, with_ids=True, cache_entries=CACHE_ENTRIES)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints, pseudonyms and packing have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage wrote is deleted once the next one has been written."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
