"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence's probability is logistic in its words; a
text's is the noisy-or of its sentences'. Only texts are labelled: the gradient of
the text's likelihood goes to each sentence by its share in it. The sentence scores
then locate what offends.

Words are runs of ASCII letters, digits and bytes above 127, A-Z lowered, in 2**18
hashed features, each word with its beginnings; sentences end at . ! ? or a line end. Null and empty texts have no
sentence and score 0. Rows without a label or with a null id are never learned
from; of repeated labels the highest counts. With one class only, the score is
that class's for all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import crc_bucket, table

#: About so many labelled texts are learned from.
SAMPLE = 10_000
FEATURES = 1 << 18
#: Besides the word itself, its first so many bytes (if it is longer) are features: stems with any ending.
BEGINNINGS = (4, 5, 6, 7, 8)
PER_WORD = 1 + len(BEGINNINGS)
#: Texts whose words the learner holds at a time.
BLOCK = 200
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True


def bags(raw: np.ndarray, offsets: np.ndarray):
    """Features of every word, first feature of every sentence (and the end), first sentence of every row (and the end), word starts and ends."""
    h, s, e, rows = kernel.words(raw, offsets, kernel.WORD_BYTE)
    h = np.concatenate([h[:, None], kernel.beginnings(raw, s, e, BEGINNINGS)], 1)
    feature = (h & np.uint64(FEATURES - 1)).astype(np.int64).ravel()
    stops = np.cumsum(ENDS[raw]) if len(raw) else np.zeros(0, np.int64)
    new = np.ones(len(s), bool)
    new[1:] = stops[s[1:]] != stops[s[:-1]]
    new[rows[:-1][rows[:-1] < len(s)]] = True
    sentences = np.flatnonzero(new)
    return feature, np.append(sentences, len(s)) * PER_WORD, np.searchsorted(sentences, rows), s, e


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def learn(texts: list[str], toxic: np.ndarray, rounds: int = 50, rate: float = 0.3, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias, by full-batch AdaGrad from smoothed log-odds."""
    y = np.asarray(toxic, float)
    pos, neg = np.zeros(FEATURES), np.zeros(FEATURES)

    def parts():
        """Bags of a few hundred texts at a time: the driver never holds all words."""
        for k in range(0, len(texts), BLOCK):
            raw, offsets = kernel.utf8(pa.array(texts[k : k + BLOCK], pa.large_string()))
            feature, sentences, rows, _, _ = bags(raw, offsets)
            yield y[k : k + BLOCK], feature, sentences, rows

    for label, feature, sentences, rows in parts():
        row = np.repeat(np.arange(len(label)), np.diff(sentences[rows]))
        pairs = np.unique(row * FEATURES + feature)
        of, label = pairs % FEATURES, label[pairs // FEATURES]
        pos += np.bincount(of, label, FEATURES)
        neg += np.bincount(of, 1 - label, FEATURES)
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    used = pos + neg >= 8
    used[0] = False  # stands for no beginning
    w = np.where(used & (odds > 2), odds, 0.0)
    features, sizes, counts = [], [], []
    for _, feature, sentences, rows in parts():
        kept = used[feature]  # the others stay at weight 0
        sizes.append(np.diff(np.concatenate([[0], np.cumsum(kept)])[sentences]))
        features.append(feature[kept].astype(np.int32))
        counts.append(np.diff(rows))
    feature = np.concatenate(features)
    sentences, rows = (np.concatenate([[0], np.cumsum(np.concatenate(x))]) for x in (sizes, counts))
    b = -4.0
    g2, b2 = np.full(FEATURES, 1e-2), 1e-2
    for _ in range(rounds):
        z = sums(w[feature], sentences) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = sums(np.log1p(-np.minimum(p, 1 - 1e-12)), rows)
        doc = -np.expm1(none)
        pull = np.where(y > 0, np.exp(none) / np.maximum(doc, 1e-9), -1.0)
        dz = np.minimum(np.repeat(pull, np.diff(rows)), 50.0) * p
        g = np.bincount(feature, np.repeat(dz, np.diff(sentences)), FEATURES) / len(y) - decay * np.sign(w)
        g[~used] = 0
        g2 += g * g
        w += rate * g / np.sqrt(g2) * (np.abs(g) > 1e-9)
        w[np.abs(w) < 1e-3] = 0
        gb = dz.sum() / len(y)
        b2 += gb * gb
        b += rate * gb / np.sqrt(b2)
    return w, b


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """About ``size`` rows (doc_id, text, toxic), chosen by a hash of the id."""
    known = labels.where("toxic is not null and doc_id is not null").where(crc_bucket("doc_id", 3) != 1).select("doc_id", "toxic")
    share = min(1.0, size / max(1, known.count()))
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(u < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def learned(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, float]:
    """What ``learn`` gives for the sample. One task learns from it, so that the driver holds the weights alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            rows = pa.Table.from_batches(found)
            w, b = learn(rows.column("text").to_pylist(), rows.column("toxic").to_numpy() > 0)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int64), w[at])] + [pa.array([float(b)])], ["at", "w", "b"])

    rows = sample(docs, labels, size).repartition(1).sortWithinPartitions("doc_id").select("text", "toxic")
    found = rows.mapInArrow(run, "at binary, w binary, b double").collect()
    w = np.zeros(FEATURES)
    if not found:
        return w, -30.0
    w[np.frombuffer(found[0].at, np.int64)] = np.frombuffer(found[0].w, float)
    return w, found[0].b


class Model:
    def __init__(self, docs: DataFrame, labels: DataFrame, size: int = SAMPLE):
        self.model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, size))

    def scores(self, docs: DataFrame) -> DataFrame:
        """doc_id, score."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = model.value
            for batch, raw, offsets in kernel.slices(batches, "text"):
                feature, sentences, rows, _, _ = bags(raw, offsets)
                z = np.clip(sums(w[feature], sentences) + b, -30, 30)
                score = -np.expm1(sums(-np.log1p(np.exp(z)), rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "score"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")

    def sentences(self, docs: DataFrame, least: float = 0.5) -> DataFrame:
        """doc_id, start and end (code points), sentence, score of the sentences at ``least`` or more."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = model.value
            for batch, raw, offsets in kernel.slices(batches, "text"):
                feature, first, rows, s, e = bags(raw, offsets)
                p = 1 / (1 + np.exp(-np.clip(sums(w[feature], first) + b, -30, 30)))
                ids, out = batch.column(0).to_pylist(), []
                for k in np.flatnonzero(p >= least):
                    r = int(np.searchsorted(rows, k, "right")) - 1
                    a, z = int(s[first[k] // PER_WORD]), int(e[first[k + 1] // PER_WORD - 1])
                    text = raw[a:z].tobytes().decode("utf-8", "replace")
                    at = len(raw[offsets[r] : a].tobytes().decode("utf-8", "replace"))
                    out.append((ids[r], at, at + len(text), text, float(p[k])))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "start", "end", "sentence", "score"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def op4_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = Model(docs, table(spark, sf_dir, "labels")).scores(docs)
    held = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
