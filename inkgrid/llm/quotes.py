"""Quotation linking: from messages that quote one another to reply-ordered conversations without quotes.

Lines that start with quote marks (>) are parsed into nested levels; a run of lines of one level is a quoted passage.
Passages, their paragraphs, lines and sentences are hashed after normalising, and joined within their conversation to the
message that wrote them first. A message replies to the earlier message most of whose words it quotes at the lowest level at
which it quotes any: deeper levels are what that message quoted itself. It joins the thread of that message. A thread is a
tree of replies, cut into branches: the first reply to a message goes on its branch, every other one begins a new branch. In a
conversation, threads, branches and messages stand in the order of their first turns, so that every message comes after what it
replies to, and right after it unless it begins a branch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_WORD = re.compile(r"\w+")
_BLANK = re.compile(r"\n(?:[ \t\r]*\n)+")
_SENTENCE = re.compile(r"(?<=[.!?:;…])[\"')\]»”’]*\s+|(?<=[。！？])")
MAX_ROUNDS = 64


def parse(text: str | None) -> tuple[list[str], list[tuple[int, str]]]:
    """The message's own lines, and its quoted passages as (level, text) in order. An attribution line right before a
    quote ("On ..., X wrote:") belongs to the quote."""
    own: list[str] = []
    passages: list[tuple[int, str]] = []
    last = 0
    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)
        level = marks[1].count(">") if marks else 0
        if level:
            if not last and own and re.search(r"(?i)\b(wrote|schrieb|a écrit|escribió)\s*:\s*$", own[-1]):
                own.pop()
            body = line[marks.end() :]
            if level == last:
                passages[-1] = (level, passages[-1][1] + "\n" + body)
            else:
                passages.append((level, body))
        else:
            own.append(line)
        last = level
    return own, passages


def normal(text: str) -> str:
    """Case-folded words with single spaces; what is left of punctuation and layout is nothing."""
    return " ".join(_WORD.findall(text.casefold()))


def _hash(text: str) -> int:
    h = xxh3_64_intdigest(text.encode(errors="replace"))
    return h - (1 << 64) if h >= 1 << 63 else h


def _keys(text: str, start: int = 0) -> set[tuple[int, int, int]]:
    """(hash, start, end) of the passage and of each of its paragraphs, lines and sentences; start and end count its words."""
    found = set()
    paragraphs = _BLANK.split(text)
    for parts in ([text], paragraphs, text.split("\n"), [s for p in paragraphs for s in _SENTENCE.split(p)]):
        at = start
        for part in parts:
            if words := normal(part):
                end = at + words.count(" ") + 1
                found.add((_hash(words), at, end))
                at = end
    return found


def _parsed(messages: DataFrame) -> DataFrame:
    """Per message: body without quotes, n_quotes, max_level, part (a hash of its text), and keys: (h, level, start, end) of
    its passages, paragraphs, lines and sentences. level is 0 for the message's own; start and end count quoted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = pa.list_(pa.struct([("h", pa.int64()), ("level", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            bodies, n_quotes, levels, parts, keys = [], [], [], [], []
            for text in batch.column(0):
                own, passages = parse(text.as_py())
                body = "\n".join(own).strip("\n")
                bodies.append(body)
                n_quotes.append(len(passages))
                levels.append(max((k for k, _ in passages), default=0))
                parts.append(_hash(text.as_py() or ""))
                found = [{"h": h, "level": 0, "start": 0, "end": 0} for h in {h for h, _, _ in _keys(body)}]
                at = 0
                for level, passage in passages:
                    spans = _keys(passage, at)
                    found += [{"h": h, "level": level, "start": i, "end": j} for h, i, j in spans]
                    at = max((j for _, _, j in spans), default=at)
                keys.append(found)
            yield pa.record_batch([*batch.columns[1:], pa.array(bodies, pa.string()), pa.array(n_quotes, pa.int64()), pa.array(levels, pa.int64()), pa.array(parts, pa.int64()), pa.array(keys, key)], names=[*batch.schema.names[1:], "body", "n_quotes", "max_level", "part", "keys"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields[1:]]
    return messages.mapInArrow(run, ", ".join([*names, "body string, n_quotes long, max_level long, part long, keys array<struct<h:bigint,level:int,start:int,end:int>>"]))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """Return conv_id, turn, role, n_quotes, max_level, reply_to, thread, branch, position, body and part for every row of conversations.

    reply_to is the turn of the message quoted most at the lowest level with a match (of equally quoted ones the latest), null
    where nothing earlier of the conversation is quoted; thread is the first turn of the chain of replies, branch the first
    turn of its branch. position grows in reply order, (conv_id, thread, branch, turn), but has gaps; part is the message without
    its quotes as a chat format has it.
    A null text is an empty message. Rows with a null conversation or turn are kept and neither quoted nor linked. Rows
    that share conversation and turn are one message in parts: they have the same reply_to, thread and branch. Columns beyond
    conv_id, turn, role and text are not read; an empty table gives an empty result.
    """
    parsed = cut(_parsed(conversations.select("text", "conv_id", "turn", "role")))
    keys = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "part", F.inline("keys"))
    quotes = keys.where("level > 0").select("conv_id", F.col("turn").alias("at"), "part", "h", "level", "start", "end").distinct()
    # Each passage has one original, the first message with it, so common lines give no more pairs than there are quotes.
    originals = keys.where("level = 0").groupBy("conv_id", "h").agg(F.min("turn").alias("turn"))
    met = quotes.join(originals, ["conv_id", "h"]).where("turn < at")
    # A paragraph holds its lines and sentences, so the words that any of them covers are counted once.
    spans = met.groupBy("conv_id", "at", "level", "turn", "part").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = "aggregate(array_sort(spans), named_struct('n', 0, 'to', 0), (s, x) -> named_struct('n', s.n + greatest(x.end - greatest(x.start, s.to), 0), 'to', greatest(s.to, x.end)), s -> s.n)"
    weight = spans.withColumn("n", F.expr(covered)).groupBy("conv_id", "at", "level", "turn").agg(F.sum("n").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "n", "turn")).alias("best")
    replies = cut(weight.groupBy("conv_id", "at").agg(best).select("conv_id", "at", F.col("best.turn").alias("reply_to")))
    first = replies.groupBy("conv_id", "reply_to").agg(F.min("at").alias("at"))
    known = replies.join(_roots(replies, "thread"), ["conv_id", "at"]).join(_roots(first.select("conv_id", "at", "reply_to"), "branch"), ["conv_id", "at"], "left")
    out = parsed.join(known.withColumnRenamed("at", "turn"), ["conv_id", "turn"], "left")
    out = cut(out.select("conv_id", "turn", "role", "n_quotes", "max_level", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("branch", "turn").alias("branch"), "body"))
    order = ["conv_id", "thread", "branch", "turn"]
    ordered = out.repartitionByRange(*order).sortWithinPartitions(*order, "role", "body")
    part = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n"))
    return ordered.withColumn("part", part).withColumn("position", F.monotonically_increasing_id())


def _roots(replies: DataFrame, name: str) -> DataFrame:
    """(conv_id, at, name): the first message of each chain of replies (conv_id, at, reply_to), by pointers that jump twice as
    far each round. What has arrived at a first message takes no part in further rounds, however many others have it too."""
    now = replies.withColumnRenamed("reply_to", "to")
    arrived = None
    for _ in range(MAX_ROUNDS):
        up = (now if arrived is None else now.union(arrived)).select("conv_id", F.col("at").alias("to"), F.col("to").alias("next"))
        jumped = cut(now.join(up, ["conv_id", "to"], "left").select("conv_id", "at", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        there = jumped.where("NOT moved").select("conv_id", "at", "to")
        arrived = there if arrived is None else arrived.union(there)
        now = jumped.where("moved").select("conv_id", "at", "to")
        if now.isEmpty():
            return arrived.withColumnRenamed("to", name)
    raise RuntimeError("chains of replies did not settle")


def chat(linked: DataFrame) -> DataFrame:
    """Messages in reply order, as chat-formatted parts: conv_id, thread, branch, turn, part."""
    return linked.select("conv_id", "thread", "branch", "turn", "position", "part").repartitionByRange("position").sortWithinPartitions("position").drop("position")
