"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from the two tokens before and the two after it:
one embedding a token, scaled by place, a tanh layer, and a softmax in two levels (the
token's class, then the token within its class). The sum of the conditional
log-probabilities scores a text.

Every distinct word of all texts has a probability of its own, and those of a place sum
to 1. The ``TOKENS - ENDINGS`` most frequent words are tokens themselves. The others are
told apart for the network by their ending, as one of ENDINGS tokens; within an ending a
word's share is its own count over that of all words with the ending. The counts of all
words stay in a table, which grows with the corpus and is joined, never sent to tasks;
what is sent has the size that TOKENS fixes.

The network is trained in numpy on every token of every text, once. Texts belong to
shards of about SHARD tokens by a hash of id and text; in each of the two rounds half of
the shards are trained on, each from the round's start in the order of id and text, and
the parameters are averaged over the shards by their examples. Shards are cut by the
data alone, so how Spark partitions the rows changes no score beyond rounding.

Words are runs of ASCII letters, digits and bytes above 127, A-Z lowered; beyond a
text's ends stands a boundary. Null and empty texts have no token, a score of 0 and a
null mean. An empty table gives an empty result. Null ids and repeated rows are scored
like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import drop, materialize, table

PLACES, HIDDEN = (-2, -1, 1, 2), 16
#: Tokens of the network, those of them that are endings, and the tokens of a class. Token TOKENS is the boundary.
TOKENS, ENDINGS, CLASS = 4096, 512, 64
CLASSES = TOKENS // CLASS
#: Bytes of a word that make its ending.
ENDING = 3
#: Tokens of a shard, about; examples of a step; its size.
SHARD, BATCH, STEP = 1_000_000, 8192, 0.3
#: Most tasks that train in a round (each sends the parameters once).
TASKS = 2048
#: Parts of the parameters that are summed by different tasks.
PARTS = 8
WORDS = "h long, ending int, n long"


class Vocabulary:
    """Token of every word: known words' hashes (sorted) and tokens, tokens of the endings, and the count of each token."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, ending_counts: np.ndarray):
        """Hashes of the known words, their counts, and the counts of the other words by ending."""
        every = np.zeros(TOKENS, np.int64)
        every[: len(counts)] = counts
        every[TOKENS - ENDINGS :] = ending_counts
        rank = np.empty(TOKENS, np.int64)
        rank[np.argsort(-every, kind="stable")] = np.arange(TOKENS)  # classes are of tokens about as frequent
        order = np.argsort(known)
        self.known, self.token = known[order], rank[: len(known)][order].astype(np.uint16)
        self.endings = rank[TOKENS - ENDINGS :].astype(np.uint16)
        self.counts = np.sort(every)[::-1].copy()
        #: Log of the count of all words of a token that is an ending; 0 for known words.
        self.shares = np.zeros(TOKENS)
        self.shares[self.endings] = np.log(np.maximum(ending_counts, 1))

    def tokens(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token of each word, and whether it is a known one."""
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        known = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        return np.where(known, self.token[at] if len(self.known) else 0, self.endings[ending]).astype(np.uint16), known


class Network:
    """Parameters as views of one float32 vector; the softmax starts at the counts' own odds."""

    SHAPES = {"embedding": (TOKENS + 1, HIDDEN), "scale": (len(PLACES), HIDDEN), "bias": (HIDDEN,), "classes": (HIDDEN, CLASSES), "class_odds": (CLASSES,), "within": (CLASSES, HIDDEN, CLASS), "odds": (CLASSES, CLASS)}

    def __init__(self, vector: np.ndarray):
        self.vector, at = vector, 0
        self.squares: dict[str, np.ndarray] = {}
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, vector[at : at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, counts: np.ndarray) -> np.ndarray:
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values()), np.float32))
        net.embedding[:] = np.random.default_rng(5).normal(0, 0.1, net.embedding.shape)
        net.scale[:] = 1
        of = counts.reshape(CLASSES, CLASS).astype(float)
        total = of.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # a token that no text has gets no probability
            net.class_odds[:] = np.maximum(np.log(total / total.sum()), -1e4)
            net.odds[:] = np.where(of > 0, np.log(of / total[:, None]), np.where(total > 0, -1e4, 0)[:, None])
        return net.vector

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.embedding[context[0]] * self.scale[0]
        for k in range(1, len(PLACES)):
            h += self.embedding[context[k]] * self.scale[k]
        h += self.bias
        return np.tanh(h, out=h)

    def _by_class(self, token: np.ndarray):
        """Order of the examples by class, and (class, begin, end) of those that occur."""
        of = (token // CLASS).astype(np.int16)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(CLASSES + 1)).tolist()
        return of, order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]

    def log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        h, at = self.hidden(context), np.arange(len(token))
        of, order, spans = self._by_class(token)
        z = h @ self.classes
        z += self.class_odds
        out = z[at, of]
        out -= np.log(np.exp(z, out=z).sum(1))
        h, place, inner = h[order], token[order] % CLASS, np.empty(len(token), np.float32)
        for c, a, b in spans:
            z = h[a:b] @ self.within[c]
            z += self.odds[c]
            chosen = z[at[: b - a], place[a:b]]
            inner[a:b] = chosen - np.log(np.exp(z, out=z).sum(1))
        out[order] += inner
        return out

    def _step(self, name: str, slope: np.ndarray, at=slice(None)) -> None:
        """AdaGrad, a step size for each parameter."""
        squares = self.squares.setdefault(name, np.ones(self.SHAPES[name], np.float32))
        squares[at] += slope * slope
        getattr(self, name)[at] -= STEP * slope / np.sqrt(squares[at])

    def train(self, context: np.ndarray, token: np.ndarray) -> None:
        """One step on these examples."""
        h, at = self.hidden(context), np.arange(len(token))
        of, order, spans = self._by_class(token)
        z = h @ self.classes
        z += self.class_odds
        np.exp(z, out=z)
        z /= z.sum(1)[:, None]
        z[at, of] -= 1
        down = z @ self.classes.T
        sorted_h, place, inner = h[order], token[order] % CLASS, np.empty_like(h)
        self._step("classes", h.T @ z)
        self._step("class_odds", z.sum(0))
        for c, a, b in spans:
            x = sorted_h[a:b]
            z = x @ self.within[c]
            z += self.odds[c]
            np.exp(z, out=z)
            z /= z.sum(1)[:, None]
            z[at[: b - a], place[a:b]] -= 1
            inner[a:b] = z @ self.within[c].T
            self._step("within", x.T @ z, c)
            self._step("odds", z.sum(0), c)
        down[order] += inner
        down *= 1 - h * h
        slopes = np.concatenate([down * self.scale[k] for k in range(len(PLACES))])
        scales = np.stack([(down * self.embedding[context[k]]).sum(0) for k in range(len(PLACES))])
        rows = context.reshape(-1)
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        slope, rows = np.add.reduceat(slopes[order], first), rows[first]
        squares = self.squares.setdefault("embedding", np.ones((TOKENS + 1, 1), np.float32))  # one step size a row
        squares[rows] += (slope * slope).mean(1, keepdims=True)
        self.embedding[rows] -= STEP * slope / np.sqrt(squares[rows])
        self._step("scale", scales)
        self._step("bias", down.sum(0))


def contexts(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Tokens at PLACES of every token; the boundary beyond the row's ends."""
    n = len(tokens)
    begin, end = np.repeat(rows[:-1], np.diff(rows)), np.repeat(rows[1:], np.diff(rows))
    at = np.arange(n)
    out = np.full((len(PLACES), n), TOKENS, np.int64)
    for k, p in enumerate(PLACES):
        ok = (at + p >= begin) & (at + p < end)
        out[k, ok] = tokens[at[ok] + p]
    return out


def word_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of every word, and each row's first word."""
    h, s, e, rows = kernel.words(raw, offsets, kernel.WORD_BYTE)
    code = np.zeros(len(h), np.uint64)
    for k in range(1, ENDING + 1):
        byte = kernel.LOWER[raw[np.maximum(e - k, s)]] if len(h) else np.zeros(0, np.uint8)
        code = code * np.uint64(256) + byte
    return h, (kernel.mix(code) % np.uint64(ENDINGS)).astype(np.int64), rows


def count_words(docs: DataFrame) -> DataFrame:
    """h, ending, n of every distinct word of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, offsets in kernel.slices(batches, "text", 4 << 20):
            h, ending, _ = word_rows(raw, offsets)
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ending[first].astype(np.int32)), pa.array(n)], ["h", "ending", "n"])

    return docs.select("text").mapInArrow(run, WORDS).groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary(words: DataFrame) -> tuple[Vocabulary, int]:
    """The tokens, and the corpus's size in words; TOKENS rows at most come to the driver."""
    top = words.orderBy(F.desc("n"), "h").limit(TOKENS - ENDINGS).select("h", "n", "ending").toPandas()
    known = top["h"].to_numpy(np.int64).view(np.uint64)
    counts = top["n"].to_numpy(np.int64)
    every, own = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in words.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        every[r.ending] = r.n
    np.add.at(own, top["ending"].to_numpy(np.int64), counts)
    return Vocabulary(known, counts, every - own), int(every.sum())


def tokenised(docs: DataFrame, words: Broadcast, shards: int) -> DataFrame:
    """A row a text: row, doc_id, t (the text's hash), shard, its tokens (two bytes each) and the hashes of its words that aren't tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words.value
        for batch, raw, offsets in kernel.slices(batches, "text"):
            h, ending, rows = word_rows(raw, offsets)
            token, known = vocabulary.tokens(h, ending)
            tokens = pa.BinaryArray.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer((2 * rows).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(token))])
            others = np.concatenate([[0], np.cumsum(~known)])[rows].astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(others), pa.array(h[~known].view(np.int64)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "t", "shard")]
            yield pa.RecordBatch.from_arrays([*columns, tokens, rare], ["row", "doc_id", "t", "shard", "tokens", "rare"])

    hashed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    hashed = hashed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "t"), F.lit(shards)).cast("int"))
    return hashed.mapInArrow(run, "row long, doc_id long, t long, shard int, tokens binary, rare array<long>")


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a batch, and each text's first."""
    raw, offsets = kernel.utf8(column)
    return np.frombuffer(raw.tobytes(), np.uint16), offsets // 2


PACKED = "part int, p binary"


def train(tokens: DataFrame, words: Broadcast, shards: int) -> np.ndarray:
    """Parameters averaged over all shards, each by the examples that it has of them."""
    spark = tokens.sparkSession
    vector = Network.start(words.value.counts)
    for k in range(2):
        start = spark.sparkContext.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            total = weights = None
            shard, net, seen, left = None, None, None, []

            def feed(last: bool) -> None:
                nonlocal left
                context, token = np.concatenate([c for c, _ in left], 1), np.concatenate([t for _, t in left])
                cut = len(token) if last else len(token) // BATCH * BATCH
                for a in range(0, cut, BATCH):
                    net.train(context[:, a : a + BATCH], token[a : a + BATCH])
                left = [(context[:, cut:], token[cut:])]

            def end() -> None:
                nonlocal total, weights, left
                if left:
                    feed(True)
                left = []
                own = examples(seen)
                moved = (net.vector - start.value) * own
                total, weights = (moved, own) if total is None else (total + moved, weights + own)

            for batch in batches:
                numbers = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if numbers[a] != shard:
                        if net is not None:
                            end()
                        shard, net, seen = numbers[a], Network(start.value.copy()), np.zeros((2, TOKENS + 1), np.int64)
                    token, rows = joined(batch.column(1).slice(a, b - a))
                    token = token.astype(np.int64)
                    context = contexts(token, rows)
                    seen[0] += np.bincount(context.reshape(-1), minlength=TOKENS + 1)
                    seen[1] += np.bincount(token, minlength=TOKENS + 1)
                    left.append((context, token))
                    if sum(len(t) for _, t in left) >= 4 * BATCH:
                        feed(False)
            if net is not None:
                end()
                for part, (p, w) in enumerate(zip(np.array_split(total, PARTS), np.array_split(weights, PARTS), strict=True)):
                    yield _packed(part, p, w)

        part = tokens.where(F.col("shard") % 2 == k).select("shard", "doc_id", "t", "tokens")
        part = part.repartition(max(1, min(-(-shards // 2), TASKS)), "shard").sortWithinPartitions("shard", "doc_id", "t").select("shard", "tokens")
        sums = part.mapInArrow(run, PACKED).repartition(PARTS, "part").mapInArrow(_summed, PACKED).collect()
        moved = [np.zeros(len(x), np.float32) for x in np.array_split(vector, PARTS)]
        for r in sums:
            moved[r.part] = np.frombuffer(r.p, np.float32)
        vector = vector + np.concatenate(moved)
        start.destroy()
    return vector


def examples(seen: np.ndarray) -> np.ndarray:
    """For each parameter, how many examples had it move; ``seen`` has the tokens of contexts and those predicted."""
    of = Network(np.zeros(sum(int(np.prod(s)) for s in Network.SHAPES.values()), np.float32))
    of.vector[:] = seen[1].sum()
    of.embedding[:] = seen[0][:, None]
    of.within[:] = seen[1][:TOKENS].reshape(CLASSES, CLASS).sum(1)[:, None, None]
    of.odds[:] = seen[1][:TOKENS].reshape(CLASSES, CLASS).sum(1)[:, None]
    return of.vector


def _packed(part: int, p: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    both = np.concatenate([p, w]).astype(np.float32).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([both], pa.binary())], ["part", "p"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of each part: sums of what the shards moved over their examples."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p = np.frombuffer(p, np.float32).astype(np.float64)
            sums[part] = sums[part] + p if part in sums else p
    for part, p in sums.items():
        moved, weight = np.split(p, 2)
        mean = (moved / np.maximum(weight, 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["part", "p"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, score (sum of the tokens' log-probabilities), n_tokens, mean_log_probability."""
    spark = docs.sparkSession
    counts = materialize(count_words(docs))
    model, size = vocabulary(counts)
    words = spark.sparkContext.broadcast(model)
    shards = 2 * max(1, -(-size // (2 * SHARD)))
    tokens = materialize(tokenised(docs, words, shards))
    vector = spark.sparkContext.broadcast(train(tokens, words, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, shares = Network(vector.value.copy()), words.value.shares
        for batch in batches:
            token, rows = joined(batch.column(2))
            token = token.astype(np.int64)
            context = contexts(token, rows)
            logs = np.concatenate([np.zeros(1), *(net.log_probability(context[:, a : a + BATCH], token[a : a + BATCH]) for a in range(0, len(token), BATCH))])
            logs[1:] -= shares[token]
            total = np.cumsum(logs, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(rows)), pa.array(total[rows[1:]] - total[rows[:-1]])], ["row", "doc_id", "n_tokens", "known"])

    scores = tokens.select("row", "doc_id", "tokens").mapInArrow(run, "row long, doc_id long, n_tokens long, known double")
    # the count of each word that is no token comes by a join with the table of all words
    rare = tokens.select("row", F.explode("rare").alias("h")).join(counts.select("h", F.log("n").alias("log_n")), "h")
    rare = rare.groupBy("row").agg(F.sum("log_n").alias("rare"))
    total = F.col("known") + F.coalesce("rare", F.lit(0.0))
    out = scores.join(rare, "row", "left").select("doc_id", total.alias("score"), "n_tokens", F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_probability"))
    out = materialize(out)
    drop(counts, tokens)
    return out


def op10_lm_scoring(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
