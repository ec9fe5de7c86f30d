"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, maxent_lm, packing, pii, prefix_trie, quality, quotes, resample, simhash_dedup, suffix_dedup, token_counts, url_filter
from .common import fold_fraction, table

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), CAPACITY)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold_fraction(F.col("doc_id"), 5) == 0)
    known = language_id.fit_dictionaries(docs.where(~F.col("held_out")))
    return language_id.identify(docs, known, keep=("doc_id", "held_out"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), CAPACITY)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"), fold_fraction(F.col("doc_id"), 7) != 2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))
    return found.select("doc_id", "text", pii.counts(F.col("_pii")).alias("n_pii"), F.expr("array_join(_pii.kind, ',')").alias("kinds"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_simhash_dedup, op4_decontamination, op5_quotation_linking, op6_url_filter, op7_quality_rules, op8_best_fit_packing, op9_lm_scoring, op10_pii, op11_suffix_dedup, op12_importance_resampling, op13_prefix_trie)}

#: The rules once more, as SQL of its own: (name, host, path, action), longest first, and patterns over host and path.
_NAMED = [("www.example.com/en/", "www.example.com", "/en/", "allow"), ("example.com/en/", "example.com", "/en/", "block"), ("net/es/", "net", "/es/", "block"), ("net/fr/", "net", "/fr/", "block"), ("com/", "com", "/", "allow")]
_FITS = ", ".join(f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{name}' END" for name, h, p, _ in _NAMED)
_ANYWHERE = (
    "porn porno xxx hentai camgirls milf escorts casino poker roulette blackjack bookmaker sportsbook betting jackpots adserver adservice adclick doubleclick popunder clickbank "
    "viagra cialis levitra tramadol xanax spam warez malware phishing keygen cracked ransomware"
)
_IN_HOST = "adult sex nude escort dating bet bets slots lotto jackpot ad ads advert banner banners tracker tracking affiliate affiliates pills meds pharmacy steroids torrent torrents crack cracks proxy hack"
_IN_A_ROW = (
    "free spins,free bets,online slots,sports bets,click track,ad server,buy followers,buy backlinks,cheap pills,cheap meds,online pharmacy,no prescription,weight loss pills,"
    "serial key,password reset verify,account verify login,free download crack"
)
_ALTERNATIVES = "|".join([*_ANYWHERE.split(), *(p.replace(" ", r"[^\p{L}\p{N}]+") for p in _IN_A_ROW.split(","))])
_BLOCKS = rf"(^|[^\p{{L}}\p{{N}}])({_ALTERNATIVES})($|[^\p{{L}}\p{{N}}])"
_BLOCKS_HOST = rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(_IN_HOST.split())})($|[^\p{{L}}\p{{N}}])"
_BLOCKS_FOLDER = "/(ads|banners|adserver/www|affiliate|cgi-bin/spam)/"

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array({{}}, '{_SPACES}'), lambda w: w <> '')"
_NOTICE = "all rights reserved|licensed under|released under the|cookie policy|privacy policy|terms of use|terms of service|enable javascript|skip to content|subscribe to our newsletter"
_ENDED = r"[.!?:;…。！？][\"\'\)\]}»”’]*[\x20\x09-\x0D]*$"
_SEPARATORS = "'|', '>', '»', '/', '•', '·', '-'"

#: DuckDB SQL. Token counts, compression, fingerprints, packing, the language model and pseudonyms have none.
ORACLE: dict[str, str] = {
    "op6_url_filter": f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT *, coalesce({_FITS}) AS rule FROM p)
        SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{name}' THEN '{action}'" for name, _, _, action in _NAMED)}
            WHEN regexp_matches(host || path, '{_BLOCKS}') OR regexp_matches(host, '{_BLOCKS_HOST}') OR regexp_matches(path, '{_BLOCKS_FOLDER}') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op7_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT k, doc_id, t, {_WORDS.format("t")} AS w FROM d),
        l AS (SELECT k, i, line, len({_WORDS.format("line")}) AS n, {_WORDS.format("line")} AS lw FROM (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
        f AS (SELECT k, n, row_number() OVER (PARTITION BY k, line ORDER BY i) > 1 AS dup, NOT regexp_matches(line, '{_ENDED.replace("'", "''")}') OR 2 * len(regexp_extract_all(line, '[#*$%&|<>!?]')) > n
            OR (len(list_filter(lw, lambda x: x IN ({_SEPARATORS}))) >= 2 AND 5 * len(list_filter(lw, lambda x: x IN ({_SEPARATORS}))) >= n) OR regexp_matches(lower(line), '{_NOTICE}') AS fails FROM l WHERE n > 0),
        s AS (SELECT k, count(*) FILTER (dup) AS dups, count(*) FILTER (fails) AS removed, coalesce(sum(n) FILTER (fails), 0) AS lost FROM f GROUP BY k),
        g AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) > 1 AS often FROM (SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2))),
        r AS (SELECT k, count(DISTINCT i + o) AS n FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE often GROUP BY k),
        b AS (SELECT w.doc_id, cast(len(w.w) AS BIGINT) AS n_words, cast(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            coalesce(dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(removed, 0) AS n_lines_removed, cast(coalesce(lost, 0) AS BIGINT) AS n_words_lost FROM w LEFT JOIN s ON s.k = w.k LEFT JOIN r ON r.k = w.k)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_lost <= 50 * n_words AS kept, n_lines_removed, n_words_lost FROM b""",
}
