"""Line-first quality rules.

Each line is judged by itself: punctuation (it ends a sentence and isn't made of marks), navigation (a row
of separated labels) and boilerplate (license and site notices). Failing lines are removed; a document that
loses too much of its text that way is rejected, as is one that fails the base counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 50
#: Of 100 words, so many may stand in repeated three-word windows.
MAX_REPEATED = 50
#: Of 100 words, so many may be lost with removed lines.
MAX_LOST = 50
SYMBOLS = "#*$%&|<>"
#: A line ends a sentence with one of these, closing quotes and brackets aside.
ENDS = ".!?:;…。！？"
CLOSERS = "\"')]}»”’"
#: Marks of which a line has at most one for every two words.
MARKS = "#*$%&|<>!?"
#: Words that separate the labels of a menu; a fifth of a line's words, and two, make it navigation.
SEPARATORS = ("|", ">", "»", "/", "•", "·", "-")
#: Notices that are no text, lower case.
BOILERPLATE = ("all rights reserved", "licensed under", "released under the", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "skip to content", "subscribe to our newsletter")

_ENDED = re.compile(rf"[{re.escape(ENDS)}][{re.escape(CLOSERS)}]*$")
_NOTICE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SPACE = " \t\n\v\f\r"
_MARK = re.compile(f"[{re.escape(MARKS)}]")
_BREAK = re.compile("[ \t\n\v\f\r]+")


@dataclass
class Judgement:
    """What one text gives; the fields in the order of the result's columns."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_lines_removed: int
    n_words_lost: int
    clean_text: str | None


def line_fails(line: str, n_words: int) -> bool:
    """Whether a line of n_words words, one at least, fails a rule."""
    if not _ENDED.search(line.rstrip(_SPACE)) or 2 * len(_MARK.findall(line)) > n_words:
        return True
    if any(s in line for s in SEPARATORS):
        separators = sum(w in SEPARATORS for w in _words(line))
        if separators >= 2 and 5 * separators >= n_words:
            return True
    return bool(_NOTICE.search(line.lower()))


def _words(text: str) -> list[str]:
    return [w for w in _BREAK.split(text) if w]


def repeated_words(words: list) -> int:
    """How many words stand in three-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, covered = 0, 0  # covered: words before this index are counted
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def judge(text: str | None) -> Judgement:
    """Judge one text; null and empty texts have no words, and so fail."""
    text = text or ""
    words = text.encode(errors="replace").split()
    n = len(words)
    seen: set[str] = set()
    duplicates = removed = lost = 0
    kept_lines = []
    for line in text.split("\n"):
        in_line = len(line.encode(errors="replace").split())
        if in_line:
            duplicates += line in seen
            seen.add(line)
            if line_fails(line, in_line):
                removed += 1
                lost += in_line
                continue
        kept_lines.append(line)
    repeated = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    kept = not base_failed and 100 * lost <= MAX_LOST * n
    chars = len(text) - sum(map(text.count, _SPACE))
    return Judgement(n, chars, sum(map(text.count, SYMBOLS)), duplicates, repeated, base_failed, kept, removed, lost, "\n".join(kept_lines))


_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")] + [T.StructField(n, T.LongType()) for n in ("n_lines_removed", "n_words_lost")] + [T.StructField("clean_text", T.StringType())])
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]


def judge_documents(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Return the columns of keep and the judgement of every row of docs; clean_text (its lines that pass) if asked for.

    Whole texts are judged, each by itself: ids may be null or repeat, an empty table gives an empty result, and a
    null text is one without words. Columns that aren't in keep are not read; those in it have names of their own, apart
    from the judgement's. Repeated rows are judged once each.
    """
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(c) for c in keep])
    width = len(_ARROW) if with_text else len(_ARROW) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [astuple(judge(t.as_py()))[:width] for t in batch.column(0)]
            columns = list(zip(*found, strict=True)) or [()] * width
            yield pa.record_batch([*batch.columns[1:], *map(pa.array, columns, _ARROW[:width])], names=[*batch.schema.names[1:], *_SCHEMA.names[:width]])

    return rows.mapInArrow(run, T.StructType(rows.schema.fields[1:] + _SCHEMA.fields[:width]))


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows of docs that are kept, with failing lines removed from the text; chars_col, if given, is counted anew.

    Columns may have any name: they travel as one. Ids may be null or repeat; null and empty texts are rejected for their
    few words; an empty table gives none.
    """
    whole = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"))
    judged = judge_documents(whole, "text", ("_row",), with_text=True).where("kept")
    new = {text_col: F.col("clean_text")} | ({chars_col: F.length("clean_text").cast(docs.schema[chars_col].dataType)} if chars_col else {})
    return judged.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])
