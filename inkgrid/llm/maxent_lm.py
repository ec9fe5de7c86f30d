"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, word before). The most frequent words are classes of their own; all
other words share classes by a hash of their endings.

P(class | context) is a softmax over hashed features of the two words before: a bias, the last word, the skip feature (the
word before it) and a hash of both. P(word | class, word before) is a softmax over the words of the class: the prior of a word
is its count plus one, and every pair of a word and a hash of the word before it that occurs in training has a weight. One more
place with a prior of one is for unknown words, so that the probabilities of all words add up to 1.

What training needs of the corpus are two tables of counts over all training texts: of classes by hashed context, and of
words by the hash of the word before. The first has at most CONTEXTS * CLASSES rows and holds every training token; the second
grows with the corpus, a weight for each of its pairs. Both are trained by distributed gradient updates: tasks sum what their
rows give to the gradient or to the normalising sums, which have a fixed size, and the driver broadcasts the new sums.
Scoring works in sparse numpy batches; counts and weights of rare words, too many to broadcast, come by a join.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The token that ends a text; no word holds white space.
END = b"\n"
#: Words that are broadcast with their counts and weights: the most frequent ones, up to about so many, of so many bytes at most.
HEAD_WORDS = 100_000
HEAD_BYTES = 64
#: Classes of one word each (END among them), and classes by ending.
OWN_CLASSES = 48
ENDING_CLASSES = 48
CLASSES = OWN_CLASSES + ENDING_CLASSES
#: Context buckets of a word: 0 begins a text, then frequent words, then endings.
OWN_BUCKETS = 40
BUCKETS = 64
CONTEXTS = BUCKETS * BUCKETS
#: Features of the hash of both words.
PAIR_FEATURES = 1024
FEATURES = 1 + 2 * BUCKETS + PAIR_FEATURES
#: Gradient updates, tasks of each, the share of a Newton step taken (four features meet in a context), and the ridge. Step and
#: ridge were chosen on a part of the training documents (crc32 mod 7 is 6) that the model was not trained on: ridges of 1 and 5
#: give them the same probability to 0.003 %, 20 one that is 0.07 % less, and 5 scores more texts above the base than 1 does.
ROUNDS = 12
GRADIENT_TASKS = 8
STEP = 0.3
RIDGE = 5.0
#: Hashes of the word before in P(word | class, word before), the hash where a text begins, and updates of its weights with
#: their ridge. Each weight is alone in its context, so it takes whole steps, of 1 at most. On the same part of the training
#: documents the weights add 0.055 to log10 of a token's probability with a ridge of 5, 0.031 with 30 and 0.013 with 150.
HASHES = 32
BEGIN = 0
WORD_ROUNDS = 4
WORD_RIDGE = 5.0
#: From so many endings on, classes and buckets repeat; what a place in the head adds to a word's code.
ENDINGS = math.lcm(ENDING_CLASSES, BUCKETS - 1 - OWN_BUCKETS)
PLACE = CLASSES * BUCKETS * HASHES
#: Distinct words that a counting task holds before it passes them on, and that a scoring task remembers.
HELD_WORDS = 500_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, and one END."""
    words = (text or "").encode(errors="replace").lower().split()
    words.append(END)
    return words


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-3:])


def _hash(word: bytes) -> int:
    """What the next word sees of this one."""
    return zlib.crc32(word) % HASHES


@dataclass
class Vocabulary:
    """The head of the word counts, and what classes and totals follow from all counts."""

    counts: dict[bytes, int]
    own: list[bytes]
    n_tokens: int
    n_words: int
    #: Least step of the counts in the head.
    least: float = math.inf
    class_mass: list[float] = field(default_factory=list)

    def class_of(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.own[:OWN_CLASSES])}

    def bucket_of(self) -> dict[bytes, int]:
        return {w: i + 1 for i, w in enumerate(self.own[:OWN_BUCKETS])}


class _Codes(dict):
    """word -> ((place in the head + 1) * CLASSES + class) * BUCKETS + bucket) * HASHES + hash, worked out at first sight; bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.classes, self.buckets = vocabulary.class_of(), vocabulary.bucket_of()
        self.places = {w: i for i, w in enumerate(vocabulary.counts, 1)}
        # Most words are seen once or twice in a task; what their endings give is worked out beforehand.
        self.endings = [self._code(OWN_CLASSES + e % ENDING_CLASSES, 1 + OWN_BUCKETS + e % (BUCKETS - 1 - OWN_BUCKETS)) for e in range(ENDINGS)]

    @staticmethod
    def _code(c: int, b: int) -> int:
        return (c * BUCKETS + b) * HASHES

    def __missing__(self, word: bytes) -> int:
        code = self.endings[_ending(word) % ENDINGS]
        if word in self.classes:
            code = self._code(self.classes[word], self.buckets.get(word, code // HASHES % BUCKETS))
        if len(self) > HELD_WORDS:
            self.clear()
        self[word] = code = self.places.get(word, 0) * PLACE + code + _hash(word)
        return code

    def split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token of one text: place in the head (-1: none), class, hashed context, and the hash of the word before."""
        codes = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        codes, hashes = np.divmod(codes, HASHES)
        codes, buckets = np.divmod(codes, BUCKETS)
        places, classes = np.divmod(codes, CLASSES)
        buckets = np.concatenate([[0, 0], buckets])
        return places - 1, classes, buckets[1:-1] * BUCKETS + buckets[:-2], np.concatenate([[BEGIN], hashes[:-1]])


_BYTES = [bytes([h]) for h in range(HASHES)]


class _Suffixes(dict):
    """word -> its hash as one byte; bounded."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > HELD_WORDS:
            self.clear()
        self[word] = suffix = _BYTES[_hash(word)]
        return suffix


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w binary, c long, pairs array of n * HASHES + h): how often each token occurs in docs, in all and behind each hash h of
    the word before it; counted in each task first. A word has at most HASHES pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = _Suffixes()
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(held)
            return pa.record_batch([pa.array([k[:-1] for k in keys], pa.binary()), pa.array([k[-1] for k in keys], pa.int32()), pa.array(held.values(), pa.int64())], names=["w", "h", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                held.update(map(operator.add, words, chain([bytes([BEGIN])], map(suffixes.__getitem__, words))))
                if len(held) > HELD_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    # One exchange by word serves both groupings.
    pairs = docs.select(text_col).mapInArrow(run, "w binary, h int, n long").repartition("w").groupBy("w", "h").agg(F.sum("n").alias("n"))
    return pairs.groupBy("w").agg(F.sum("n").alias("c"), F.collect_list(F.col("n") * HASHES + F.col("h")).alias("pairs"))


def _step() -> Column:
    """Counts in steps of an eighth of an octave, so that their histogram has a few hundred rows at any size."""
    return F.floor(F.log2("c") * 8)


def _in_head(least: float) -> Column:
    """Words of the head; END, which has a class of its own, is one of them whatever its count."""
    return (F.col("w") == F.lit(END)) | ((_step() >= int(least) if least < math.inf else F.lit(False)) & (F.octet_length("w") <= HEAD_BYTES))


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals over all counts, and the head: all words of at least the least count that leaves HEAD_WORDS or fewer."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(_step().alias("step")).count().collect()), reverse=True)
    least, room = math.inf, HEAD_WORDS
    for s, n in sizes:
        if n > room:
            break
        least, room = s, room - n
    head = counts.where(_in_head(least)).select("w", "c").toArrow()
    ranked = sorted(zip(head["w"].to_pylist(), head["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    own = [w for w, _ in ranked if w != END][: OWN_CLASSES - 1]
    vocabulary = Vocabulary(dict(ranked), [END, *own], totals["n"] or 0, totals["v"], least)
    ending = F.crc32(F.substring("w", -3, 3)) % ENDING_CLASSES + OWN_CLASSES
    rest = counts.where(~F.col("w").isin(vocabulary.own)).groupBy(ending.alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect()
    mass = {r["k"]: float(r["m"]) for r in rest}
    # A class of one word gives it all of its mass; an ending's class has a place for unknown words too.
    own_mass = [vocabulary.counts.get(w, 0) + 1.0 for w in vocabulary.own] + [1.0] * (OWN_CLASSES - len(vocabulary.own))
    vocabulary.class_mass = own_mass + [mass.get(k, 0.0) + 1.0 for k in range(OWN_CLASSES, CLASSES)]
    return vocabulary


def count_contexts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """(context int, class int, n long): how often each class follows each hashed context in docs."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _Codes(known.value)
        total = np.zeros(CONTEXTS * CLASSES, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal total, held, size
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
            held, size = [], 0

        for batch in batches:
            for text in batch.column(0):
                _, classes, contexts, _ = coded.split(tokens(text.as_py()))
                held.append(contexts * CLASSES + classes)
                size += len(classes)
                if size > 1_000_000:
                    add()
        add()
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at // CLASSES, pa.int32()), pa.array(at % CLASSES, pa.int32()), pa.array(total[at])], names=["context", "class", "n"])

    return docs.select(text_col).mapInArrow(run, "context int, class int, n long").groupBy("context", "class").agg(F.sum("n").alias("n"))


def _features(contexts: np.ndarray) -> np.ndarray:
    """The four features of each context: bias, last word, skip word, hash of both."""
    last, skip = contexts // BUCKETS, contexts % BUCKETS
    pair = (contexts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PAIR_FEATURES
    return np.stack([np.zeros_like(contexts), 1 + last, 1 + BUCKETS + skip, 1 + 2 * BUCKETS + pair], axis=1)


def _log_softmax(weights: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    logits = weights[_features(contexts)].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def train(context_counts: DataFrame) -> np.ndarray:
    """Weights (FEATURES, CLASSES) by ROUNDS distributed gradient updates over the count table."""
    spark = context_counts.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((CONTEXTS, CLASSES))
        for batch in batches:
            context, k, n = (c.to_numpy() for c in batch.columns)
            np.add.at(dense, (context, k), n)
        at = np.flatnonzero(dense.any(axis=1))
        if len(at):
            yield pa.record_batch([pa.array([at.tobytes()], pa.binary()), pa.array([dense[at].tobytes()], pa.binary())], names=["contexts", "counts"])

    # One row for each task, of fixed size at most, which every update reads.
    table = cut(context_counts.repartition(GRADIENT_TASKS, "context").mapInArrow(pack, "contexts binary, counts binary"))
    weights = np.zeros((FEATURES, CLASSES))
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, curve = np.zeros((2, FEATURES, CLASSES))
            for batch in batches:
                for packed, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    contexts, n = np.frombuffer(packed, dtype=np.int64), np.frombuffer(counts).reshape(-1, CLASSES)
                    p = np.exp(_log_softmax(now.value, contexts))
                    total = n.sum(axis=1, keepdims=True)
                    missed, spread = n - total * p, total * p * (1 - p)
                    for f in _features(contexts).T:
                        order = np.argsort(f, kind="stable")
                        found, starts = np.unique(f[order], return_index=True)
                        gradient[found] += np.add.reduceat(missed[order], starts)
                        curve[found] += np.add.reduceat(spread[order], starts)
            yield pa.record_batch([pa.array([np.stack([gradient, curve]).tobytes()], pa.binary())], names=["sums"])

        # However many partitions the table has, GRADIENT_TASKS tasks at most sum them up and return an array of fixed size each.
        parts = table.coalesce(GRADIENT_TASKS).mapInArrow(run, "sums binary").collect()
        if not parts:
            break
        gradient, curve = sum(np.frombuffer(r["sums"]).reshape(2, FEATURES, CLASSES) for r in parts)
        weights = weights + STEP * np.clip((gradient - RIDGE * weights) / (curve + RIDGE), -4, 4)
        now.unpersist()
    return weights


@dataclass
class WordModel:
    """P(word | class, word before) but for the weights, which follow from these sums and the counts of a pair.

    totals (CLASSES, HASHES): tokens of each class behind each hash. path: the normalising sums before each update. sums: those
    after the last one.
    """

    totals: np.ndarray
    ridge: float
    path: list[np.ndarray]
    sums: np.ndarray

    def weights(self, classes: np.ndarray, hashes: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Weights of pairs after all updates: the way of each from 0 along the path. A class of one word has none."""
        weights = np.zeros(len(n))
        shared = classes >= OWN_CLASSES
        for z in self.path:
            p = np.minimum(prior * np.exp(weights) / z[classes, hashes], 1.0)
            expected = self.totals[classes, hashes] * p
            weights += shared * np.clip((n - expected - self.ridge * weights) / (expected * (1 - p) + self.ridge), -1, 1)
        return weights


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of (class, c, pairs): how many pairs each word has, and of each pair its class, hash, count and the word's prior."""
    lengths = pc.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False)
    n, h = np.divmod(batch.column("pairs").flatten().to_numpy(zero_copy_only=False), HASHES)
    return lengths, np.repeat(batch.column("class").to_numpy(), lengths), h, n, np.repeat(batch.column("c").to_numpy() + 1.0, lengths)


def _with_class(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Words with their classes; for those that are classes of their own, which need no weights, the first one stands."""
    ending = (F.crc32(F.substring("w", -3, 3)) % ENDING_CLASSES + OWN_CLASSES).cast("int")
    return counts.withColumn("class", F.when(F.col("w").isin(vocabulary.own), 0).otherwise(ending))


def train_words(counts: DataFrame, vocabulary: Vocabulary, rounds: int = WORD_ROUNDS, ridge: float = WORD_RIDGE) -> WordModel:
    """rounds distributed gradient updates of P(word | class, word before): each adds up the normalising sums over all
    pairs, a fixed number of cells, from which each pair's next weight follows where the pair lies."""
    spark = counts.sparkSession
    rows = _with_class(counts, vocabulary).select("class", "c", "pairs")

    def add_up(value) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(CLASSES * HASHES)
            for batch in batches:
                _, classes, h, n, prior = _pairs(batch)
                total += np.bincount(classes * HASHES + h, weights=value(classes, h, n, prior), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "v"])

        found = np.zeros(CLASSES * HASHES)
        for r in rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
            found[r["cell"]] = r["v"]
        return found.reshape(CLASSES, HASHES)

    prior_sums = np.repeat(np.array(vocabulary.class_mass)[:, None], HASHES, axis=1)
    model = WordModel(add_up(lambda classes, h, n, prior: n), ridge, [], prior_sums)
    for _ in range(rounds):
        model.path.append(model.sums)
        now = spark.sparkContext.broadcast(model)
        model.sums = prior_sums + add_up(lambda classes, h, n, prior, now=now: prior * np.expm1(now.value.weights(classes, h, n, prior)))
        now.unpersist()
    return model


def weigh_words(counts: DataFrame, vocabulary: Vocabulary, model: WordModel) -> DataFrame:
    """(w, c, hs, ts): every counted word with the hashes of the words before it and the weights of those pairs."""
    known = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, classes, h, n, prior = _pairs(batch)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            weights = known.value.weights(classes, h, n, prior).astype(np.float32)
            yield pa.record_batch([batch.column("w"), batch.column("c"), pa.ListArray.from_arrays(ends, pa.array(h, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weights))], names=["w", "c", "hs", "ts"])

    return _with_class(counts, vocabulary).select("w", "c", "pairs", "class").mapInArrow(run, "w binary, c long, hs array<int>, ts array<float>")


def head_weights(words: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """(words in the head, HASHES) weights of the pairs of words, those of the head, and 0 for pairs that don't occur."""
    head = words.select("w", "hs", "ts").toArrow()
    places = {w: i for i, w in enumerate(vocabulary.counts)}
    at = np.array([places[w] for w in head["w"].to_pylist()], dtype=np.int64)
    lengths = pc.list_value_length(head["hs"]).to_numpy()
    weights = np.zeros((len(places), HASHES), dtype=np.float32)
    weights[np.repeat(at, lengths), pc.list_flatten(head["hs"]).to_numpy()] = pc.list_flatten(head["ts"]).to_numpy()
    return weights


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows of docs for which learns is true, and score every row's whole text.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score (an add-one unigram model) and score (this
    model), log10 of the text's probability each. A null text counts as empty: one END. Ids may be null or repeat, as every
    row is scored by itself; other columns are not read. Without training rows every class is as likely as another.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), learns.alias("learns"))
    taught = rows.where("learns").select("text")
    counts = cut(count_words(taught))
    vocabulary = read_vocabulary(counts)
    weights = train(count_contexts(taught, vocabulary))
    model = train_words(counts, vocabulary)
    in_head = _in_head(vocabulary.least)
    head = weigh_words(counts.where(in_head), vocabulary, model)
    rare_words = weigh_words(counts.where(~in_head), vocabulary, model)
    # log10 of P(class | context), and of the sum that normalises the words of a class.
    by_context = _log_softmax(weights, np.arange(CONTEXTS)) / math.log(10)
    known = spark.sparkContext.broadcast((vocabulary, by_context.ravel(), np.log10(model.sums), head_weights(head, vocabulary) / np.float32(math.log(10))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, by_context, log_sums, in_head = known.value
        coded = _Codes(vocabulary)
        plus_one = np.log10(np.fromiter(vocabulary.counts.values(), dtype=np.float64, count=len(vocabulary.counts)) + 1)
        for batch in batches:
            kinds = {"row": pa.int64(), "id": batch.schema.field("id").type, "learns": pa.bool_(), "w": pa.binary(), "h": pa.int32(), "n": pa.int64(), "n_known": pa.int64(), "a": pa.float64(), "m": pa.float64()}
            sums: dict[str, list] = {c: [] for c in kinds if c != "h"}
            asked: dict[str, list] = {c: [] for c in ("row", "w", "h", "n")}

            def flush(found: dict[str, list], kinds: dict = kinds) -> pa.RecordBatch:
                size = len(found["row"])
                made = pa.record_batch([pa.array(found[c], k) if c in found else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))
                for x in found.values():
                    x.clear()
                return made

            for row, own_id, learns, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                words = tokens(text.as_py())
                places, classes, contexts, before = coded.split(words)
                found = places >= 0
                m = float((by_context[contexts * CLASSES + classes] - log_sums[classes, before]).sum() + in_head[places[found], before[found]].sum(dtype=np.float64))
                at = np.flatnonzero(~found)
                rare = Counter(zip([words[i] for i in at.tolist()], before[at].tolist(), strict=True))
                a = float(plus_one[places[found]].sum())
                # The row's own sums travel under a key that is no word and that no other row has.
                for x, new in zip(sums.values(), (row, own_id, learns, END + str(row).encode(), len(words), len(words) - len(at), a, m), strict=True):
                    x.append(new)
                if rare:
                    for x, new in zip(asked.values(), ([row] * len(rare), *zip(*rare, strict=True), rare.values()), strict=True):
                        x.extend(new)
                if len(asked["row"]) > 100_000:
                    yield flush(asked)
            yield flush(sums)
            yield flush(asked)

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "learns", "text")
    parts = keyed.mapInArrow(run, f"row long, id {kind}, learns boolean, w binary, h int, n long, n_known long, a double, m double")
    met = parts.join(rare_words, "w", "left")
    own = F.col("m").isNotNull()
    weight = F.coalesce(F.get("ts", (F.array_position("hs", F.col("h")) - 1).cast("int")).cast("double"), F.lit(0.0)) / math.log(10)
    sums = met.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("learns").alias("learns"),
        F.sum(F.when(own, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(own, F.col("n_known")).otherwise(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.when(own, F.col("a")).otherwise(F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0)))).alias("a"),
        F.sum(F.when(own, F.col("m")).otherwise(F.col("n") * weight)).alias("m"),
    )
    total = F.lit(vocabulary.n_tokens)
    base = F.col("a") - F.col("n_tokens") * F.log10(total + vocabulary.n_words + 1.0)
    return sums.select(F.col("id").alias(id_col), (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", total.cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("a") + F.col("m")).alias("score"))
