"""Language identification by compression.

Each language has a Zstandard raw-content dictionary cut from labelled texts of that language. A
text is compressed once with each; the dictionary that makes it smallest names its language. A
narrow margin between the two smallest marks the prediction as not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: The bounded training sample: about so many labelled rows of each language, whole texts in blocks of so many characters,
#: and bytes of dictionary from blocks of them all.
SAMPLE_ROWS = 256
BLOCK_CHARS = 512
DICT_BYTES = 110_000
#: Compression level, chosen among 3, 9 and 15 on a part of the training documents that dictionaries weren't cut from.
LEVEL = 9
#: Accepted are predictions whose best size is smaller than the next by this share of it at least.
MARGIN = 0.02
UNDETERMINED = "und"


def fit_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language from a bounded sample of the labelled rows.

    Of each language's n rows about SAMPLE_ROWS are taken, those whose text's hash is in the first SAMPLE_ROWS / n of the
    hash range (copies count once). Their whole texts, lower-cased, are cut into blocks, and blocks fill the dictionary in the
    order of a hash, wherever in a text they stand. Rows without text or label are left out; ties of hashes go by the text.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return {}
    steps = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, min(steps, steps * SAMPLE_ROWS // n)))])
    picked = rows.where("text <> ''").withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(steps)) < share[F.col("lang")]).dropDuplicates(["lang", "h"])
    blocks = picked.select("lang", "h", "text", F.explode(F.expr(f"sequence(0, (length(text) - 1) div {BLOCK_CHARS})")).alias("k"))
    blocks = blocks.select("lang", F.xxhash64("h", "k").alias("order"), F.expr(f"substring(text, 1 + k * {BLOCK_CHARS}, {BLOCK_CHARS})").alias("block"))
    # A block has as many bytes as characters at least, so these fill the dictionary.
    first = F.row_number().over(W.partitionBy("lang").orderBy("order", "block"))
    chosen = blocks.withColumn("rank", first).where(F.col("rank") <= 2 * DICT_BYTES // BLOCK_CHARS).collect()
    by_lang: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["rank"])):
        by_lang[r["lang"]].append(r["block"])
    return {lang: "\n".join(found).encode(errors="replace")[:DICT_BYTES] for lang, found in sorted(by_lang.items())}


@cache
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list:
    import zstandard as z

    found = []
    for lang, content in dictionaries:
        if not content:  # a language of empty texts has nothing to compress with
            continue
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        found.append((lang, z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return found


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """Language, score (the margin as a share of the second-smallest size) and whether the margin is wide enough.

    Null texts, and texts without a letter, are undetermined. Ties go to the language that sorts first.
    """
    if text is None or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, False
    data = text.lower().encode(errors="replace")
    sizes = sorted((len(c.compress(data)), lang) for lang, c in _compressors(dictionaries))
    if not sizes:
        return UNDETERMINED, 0.0, False
    if len(sizes) == 1:
        return sizes[0][1], 1.0, True
    margin = (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])
    return sizes[0][1], margin, margin >= MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Return the columns of keep with lang_pred, score (0 to 1) and accepted (false: rejected for its narrow margin).

    Whole texts are compressed. Every row gives a row, nulls, repeats and ties included; an empty table gives none.
    """
    known = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))
    rows = docs.select(F.col(text_col).alias("_text"), *keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(t, known.value) for t in batch.column(0).to_pylist()]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([*batch.columns[1:], *new], names=[*batch.schema.names[1:], "lang_pred", "score", "accepted"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return rows.mapInArrow(predict, schema)
