"""URL filters with DataFrame functions only.

Every rule is a regular expression with literal tokens that each URL it fits must hold. The index files
a rule under the rarest of its tokens, by their counts over all URLs. It is a constant of the plan, a hash table as an
array of buckets: a URL's own tokens fetch their candidate rules from it in the scan's own stage, and only those run
their expressions. Nothing of a URL is joined or shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of letters and digits; the same in rules and URLs.
APART = r"[^\p{L}\p{N}]+"
_EDGE = r"[^\p{L}\p{N}]"


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path together, lower-cased host first; name and rank only for rules that are reported."""

    pattern: str
    tokens: tuple[str, ...]
    action: str
    name: str | None = None


def host_rule(host: str, path: str, action: str) -> Rule:
    """Fits a host and all its subdomains, if the path starts with path."""
    literal = f"{host}{path}"
    tokens = re.findall(r"[^\W_]+", literal)
    if tokens and re.search(r"[^\W_]$", path):
        tokens = tokens[:-1]  # the path may go on within its last token
    return Rule(rf"^(?:[^/?#]*\.)?{re.escape(literal)}", tuple(tokens), action, literal)


def phrase_rule(*words: str, action: str = "block") -> Rule:
    """Fits URLs that hold the words as whole tokens one after another, with marks between them, in host or path."""
    return Rule(rf"(?:^|{_EDGE}){f'{_EDGE}+'.join(map(re.escape, words))}(?:$|{_EDGE})", words, action)


def host_word_rule(word: str, action: str = "block") -> Rule:
    """Fits URLs that hold the word as a whole token of the host."""
    return Rule(rf"^(?:[^/]*[^/\p{{L}}\p{{N}}])?{re.escape(word)}(?:$|{_EDGE})", (word,), action)


def folder_rule(*folders: str, action: str = "block") -> Rule:
    """Fits URLs whose path holds these folders one after another, whatever the host."""
    return Rule(rf"/{'/'.join(map(re.escape, folders))}/", folders, action)


#: The rules of the contract.
HOST_RULES = [host_rule("com", "/", "allow"), host_rule("example.com", "/en/", "block"), host_rule("www.example.com", "/en/", "allow"), host_rule("net", "/es/", "block"), host_rule("net", "/fr/", "block")]
#: What blocks a URL for which none of those speaks, by category. Words that also have a harmless sense count in
#: hosts only, or together with another word.
WORDS = {
    "adult": ("porn", "porno", "xxx", "hentai", "camgirls", "milf", "escorts"),
    "gambling": ("casino", "poker", "roulette", "blackjack", "bookmaker", "sportsbook", "betting", "jackpots"),
    "advertising": ("adserver", "adservice", "adclick", "doubleclick", "popunder", "clickbank"),
    "pharmacy": ("viagra", "cialis", "levitra", "tramadol", "xanax"),
    "harm": ("spam", "warez", "malware", "phishing", "keygen", "cracked", "ransomware"),
}
HOST_WORDS = {
    "adult": ("adult", "sex", "nude", "escort", "dating"),
    "gambling": ("bet", "bets", "slots", "lotto", "jackpot"),
    "advertising": ("ad", "ads", "advert", "banner", "banners", "tracker", "tracking", "affiliate", "affiliates"),
    "pharmacy": ("pills", "meds", "pharmacy", "steroids"),
    "harm": ("torrent", "torrents", "crack", "cracks", "proxy", "hack"),
}
PHRASES = {
    "gambling": (("free", "spins"), ("free", "bets"), ("online", "slots"), ("sports", "bets")),
    "advertising": (("click", "track"), ("ad", "server"), ("buy", "followers"), ("buy", "backlinks")),
    "pharmacy": (("cheap", "pills"), ("cheap", "meds"), ("online", "pharmacy"), ("no", "prescription"), ("weight", "loss", "pills")),
    "harm": (("serial", "key"), ("password", "reset", "verify"), ("account", "verify", "login"), ("free", "download", "crack")),
}
FOLDERS = {"advertising": (("ads",), ("banners",), ("adserver", "www"), ("affiliate",)), "harm": (("cgi-bin", "spam"),)}
WORD_RULES = [
    *[phrase_rule(w) for words in WORDS.values() for w in words],
    *[host_word_rule(w) for words in HOST_WORDS.values() for w in words],
    *[phrase_rule(*p) for phrases in PHRASES.values() for p in phrases],
    *[Rule(folder_rule(*f).pattern, tuple(t for x in f for t in x.split("-")), "block") for folders in FOLDERS.values() for f in folders],
]


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _index(urls: DataFrame, rules: list[Rule]) -> Column:
    """Buckets of (token, pattern, action, name), by the token's crc32: each rule under its rarest token. urls holds tokens."""
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    of_rules = sorted({t for r in rules for t in r.tokens})
    own = F.from_json(F.lit(json.dumps(_buckets([(t, t) for t in of_rules]))), "array<array<string>>")
    known = F.filter("tokens", lambda t: F.array_contains(_bucket(own, t), t))
    counted = urls.select(F.explode(F.array_distinct(known)).alias("token")).groupBy("token").count()
    count = {r["token"]: r["count"] for r in counted.collect()}  # a row for each token of the rules at most
    rows = [(min(r.tokens, key=lambda t: (count.get(t, 0), t)), r) for r in rules]
    buckets = _buckets([(t, {"token": t, "pattern": r.pattern, "action": r.action, "name": r.name}) for t, r in rows])
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<token:string,pattern:string,action:string,name:string>>>")


def _buckets(entries: list[tuple]) -> list[list]:
    buckets: list[list] = [[] for _ in range(2 * len(entries))]
    for token, entry in entries:
        buckets[zlib.crc32(token.encode()) % len(buckets)].append(entry)
    return buckets


def _bucket(buckets: Column, token: Column) -> Column:
    return F.get(buckets, F.pmod(F.crc32(token.cast("binary")), F.size(buckets)).cast("int"))


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Return id_col, host, path, rule and verdict for every row of pages.

    rule: the longest fitting rule that has a name (of equal ones the first by name), whose action is the verdict. Without
    one, the verdict is block if an unnamed blocking rule fits, else allow. A null URL, or one without ://, has empty host
    and path and is allowed. Ids may be null or repeat: every row is judged by itself, in whatever length. Other columns are
    not read; an empty table gives none. rules are a list of the driver's, of any length.
    """
    rules = HOST_RULES + WORD_RULES if rules is None else rules
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"))
    # Rules are in lower case; the path keeps its case for those that have a name.
    rows = rows.withColumn("target", F.concat("host", "path")).withColumn("tokens", F.array_remove(F.split("target", APART), ""))
    if not rules:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    index = _index(rows, rules)
    tried = F.flatten(F.transform(F.array_distinct("tokens"), lambda t: F.filter(_bucket(index, t), lambda r: r["token"] == t)))
    judged = rows.select("id", "host", "path", F.filter(tried, lambda r: F.regexp_like(F.col("target"), r["pattern"])).alias("fits"))
    named = F.transform(F.filter("fits", lambda r: r["name"].isNotNull()), lambda r: F.struct((-F.length(r["name"])).alias("short"), r["name"].alias("name"), r["action"].alias("action")))
    judged = judged.select("id", "host", "path", F.array_min(named).alias("best"), F.exists("fits", lambda r: r["name"].isNull() & (r["action"] == "block")).alias("blocked"))
    verdict = F.coalesce("best.action", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"))
