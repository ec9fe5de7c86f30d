"""Token counts by a two-tier lookup that runs inside the scan's own tasks.

A white-space separated piece is the coarsest pre-token that the tokenizer never joins with its
neighbours, so a text's tokens are the tokens of its pieces, one after another. Tier one is a
compact table, broadcast once, of the lengths of frequent pre-tokens: the whole words that the
tokenizer's own vocabulary was merged up to (its size is the vocabulary's, whatever the corpus).
Tier two is a cache in each Python worker, filled by encoding what tier one lacks. No pre-token is
shuffled: the plan is scan -> map.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's cache before it starts anew, and the longest piece (in characters) that it keeps.
CACHE_ENTRIES = 600_000
CACHE_CHARS = 64
#: Rows of a batch are worked off in groups of about so many characters, so that split texts stay small.
GROUP_CHARS = 1_000_000
#: Characters that str.split() takes as white space and the tokenizer does not.
_PYTHON_ONLY_SPACE = "\x1c\x1d\x1e\x1f"


@cache
def tokenizer(path: str):
    """The tokenizer, loaded once for each process; Spark's tasks are its threads."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_pieces(tok, pieces: list[str]) -> list[bytes]:
    """Ids of each piece, by the library, as little-endian unsigned 32-bit numbers."""
    return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(pieces, add_special_tokens=False)]


def splits_at_space(tok) -> bool:
    """Whether white space separates this tokenizer's pre-tokens and is itself dropped."""
    ids = lambda text: tok.encode(text, add_special_tokens=False).ids
    return ids(" a  b\n") == ids("a") + ids("b") and not ids(" \n\t")


#: Printable characters of ASCII, Latin-1 and Latin Extended-A, but those whose lower case is more than one. NFC leaves texts of
#: these as they are, and their categories are the same in all versions of Unicode.
_LATIN = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x180)]) if len(c.lower()) == 1]
_all_latin = re.compile(f"[{re.escape(''.join(_LATIN))} ]*").fullmatch


def latin_pretokens(tok) -> re.Pattern | None:
    """What this tokenizer cuts lower-cased texts of _LATIN and blanks into, or a blank; None if it isn't known to make them
    lower case, take the matches of a pattern, and turn these into bytes."""
    rules = json.loads(tok.to_str())
    normal, cuts = ((rules[of] or {}).get(f"{of.replace('_', '')}s", []) for of in ("normalizer", "pre_tokenizer"))
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if normal != [{"type": "NFC"}, blanks, {"type": "Lowercase"}] or len(cuts) != 2:
        return None
    split, level = cuts
    if split | {"pattern": 0} != {"type": "Split", "pattern": 0, "behavior": "Removed", "invert": True} or level | {"trim_offsets": 0} != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": 0, "use_regex": False}:
        return None
    pattern = split["pattern"].get("Regex", r"\p")
    for kind in "LN":
        pattern = pattern.replace(f"\\p{{{kind}}}", "".join(c for c in _LATIN if unicodedata.category(c)[0] == kind))
    return None if re.search(r"\\[^s]", pattern) else re.compile(f"{pattern}| ")


class PieceCache:
    """Worker-side caches with bounded memory: from a white-space separated piece to its ids (or only their number), and,
    for pieces at first sight, from the tokenizer's own pre-tokens to theirs."""

    def __init__(self, path: str, lengths_only: bool, seed: dict | None = None, entries: int | None = None):
        self.entries = CACHE_ENTRIES if entries is None else entries
        self.tok = tokenizer(path)
        self.value = (lambda b: len(b) // 4) if lengths_only else bytes
        self.seed = seed or {}
        self.by_piece: dict = dict(self.seed)
        self.by_pretoken: dict[str, bytes] = {}
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.latin = latin_pretokens(self.tok)
        self.bytes_of = {ord(c): self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LATIN} if self.latin else {}

    def whole(self, text: str):
        """A whole text by the library."""
        return self.value(encode_pieces(self.tok, [text])[0])

    def fill(self, texts: list[list[str]]) -> dict:
        """Encode the pieces of split texts that the cache lacks; short ones are kept, long ones returned.

        A full cache starts anew before, with what it has of these texts, so that frequent pieces stay and all pieces of
        these texts are there afterwards.
        """
        wanted = set().union(*texts)
        if len(self.by_piece) > self.entries + len(self.seed):
            self.by_piece = self.seed | {p: self.by_piece[p] for p in wanted.intersection(self.by_piece)}
        missing, extra = list(wanted.difference(self.by_piece)), {}
        for start in range(0, len(missing), 4096):
            part = missing[start : start + 4096]
            for piece, ids in zip(part, self._encode(part), strict=True):
                (self.by_piece if len(piece) <= CACHE_CHARS else extra)[piece] = self.value(ids)
        return extra

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space: those of _LATIN through the tokenizer's own model, by pre-tokens; others, and
        those that hold a special string, by the library whole."""
        joined = " ".join(pieces)
        if self.latin is None or any(a in joined for a in self.added):
            return encode_pieces(self.tok, pieces)
        if not _all_latin(joined):
            found: list = [p if _all_latin(p) else None for p in pieces]
            odd = iter(encode_pieces(self.tok, [p for p, f in zip(pieces, found, strict=True) if f is None]))
            plain = iter(self._encode([f for f in found if f is not None]))
            return [next(odd if f is None else plain) for f in found]
        if not pieces:
            return []
        if len(self.by_pretoken) > self.entries:
            self.by_pretoken.clear()
        known, tokenize = self.by_pretoken, self.tok.model.tokenize
        parts = self.latin.findall(joined.lower())
        fresh = {" ": b" "}  # a blank ends a piece
        for p in set(parts).difference(known, fresh):
            ids = [t.id for t in tokenize(p if p.isascii() else p.translate(self.bytes_of))]
            (known if len(p) <= CACHE_CHARS else fresh)[p] = struct.pack(f"<{len(ids)}I", *ids)
        out, start = [], 0
        ends = [k for k, p in enumerate(parts) if p == " "]
        for end in [*ends, len(parts)]:
            if end - start == 1 and parts[start] in known:
                out.append(known[parts[start]])
            else:
                out.append(b"".join([known[p] if p in known else fresh[p] for p in parts[start:end]]))
            start = end + 1
        return out


def text_groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in order, in groups of bounded size; null is the empty text."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


_caches: dict[tuple[str, bool, int | None], PieceCache] = {}


def worker_cache(path: str, lengths_only: bool, seed: dict | None = None, entries: int | None = None) -> PieceCache:
    """One cache for each worker process; Spark reuses workers, so it stays warm over tasks. It also stays while the worker
    does other work: jobs that go on with other stages ask for few entries (CACHE_ENTRIES if none are given)."""
    key = (path, lengths_only, entries)
    if key not in _caches:
        _caches[key] = PieceCache(path, lengths_only, seed, entries)
    return _caches[key]


def frequent_lengths(path: str) -> dict[str, int]:
    """Token counts of the vocabulary's whole words, as themselves, capitalised, and before a comma or stop."""
    tok = tokenizer(path)
    if not splits_at_space(tok):
        return {}
    words = {w[: -len("</w>")] for w in tok.get_vocab(with_added_tokens=False) if w.endswith("</w>")}
    forms = sorted({f for w in words if w.isalpha() and w.isascii() for f in (w, w.capitalize(), w + ",", w + ".")})
    return {f: len(ids) // 4 for f, ids in zip(forms, encode_pieces(tok, forms), strict=True)}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id_col, n_bytes, n_tokens and over_limit for every row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. An id may be null or repeat; every row gives a row.
    Other columns, whatever their names, are not read. An empty table gives an empty result.
    Counts equal the tokenizer's own for the whole text, special strings in a text included.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache(path, True, table.value)  # tier one is the seed of tier two: one lookup a piece
        by_space = splits_at_space(own.tok)
        for batch in batches:
            counts: list[int] = []
            for group in text_groups(batch.column(1).to_pylist()):
                pieces = [text.split() if by_space else [] for text in group]
                extra = own.fill(pieces)
                known = own.by_piece.__getitem__
                for text, parts in zip(group, pieces, strict=True):
                    if not by_space or any(c in text for c in _PYTHON_ONLY_SPACE):
                        counts.append(own.whole(text))
                    elif extra and not extra.keys().isdisjoint(parts):
                        counts.append(sum(extra[p] if p in extra else known(p) for p in parts))
                    else:
                        counts.append(sum(map(known, parts)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
