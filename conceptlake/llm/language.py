"""Language ID with segmentation-marginalised unigrams.

A word is a sequence of pieces of a fixed public vocabulary in any of the ways it
can be cut. Each language has a probability per piece; a word's probability sums
over all segmentations (forward algorithm), a text's is the product over its words.
The piece probabilities are learned by expectation maximisation (forward-backward)
on a bounded sample of labelled texts.

Words are runs of ASCII letters and bytes above 127, A-Z lowered, led by the
vocabulary's word mark; a word over 31 bytes is cut every 31 bytes. Single bytes are
always pieces, so every word has a segmentation. Null texts and texts without a
letter get ``und`` and score 0. With no labelled text at all, every text gets
``und``. Null ids are never learned from. Only the text decides.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import crc_bucket, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: About so many texts of each language are learned from.
SAMPLE = 120
CHUNK, LONGEST = 31, 14
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: Words whose segmentations the learner sums at a time.
BLOCK = 8000


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as bytes (word mark as a blank, A-Z lowered), every single byte among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            p = model.id_to_piece(i).replace("▁", " ").encode().lower()
            if 0 < len(p) <= LONGEST and b" " not in p[1:]:
                found.add(p)
    return sorted(found)


class Lattice:
    """All pieces at all places of a set of words, by start and length."""

    def __init__(self, vocabulary: list[bytes]):
        codes = np.array([self._code(p) for p in vocabulary], np.uint64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.codes >> np.uint64(44)] = True
        self.single = np.array([vocabulary.index(bytes([b])) for b in range(256)])

    @staticmethod
    def _code(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(kernel.BASE) + b + 1) % (1 << 64)
        return (h * 0x7FB5D329728EA185 + len(piece)) % (1 << 64)

    def places(self, matrix: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces); ``lengths`` descend, row w of ``matrix`` has word w's bytes."""
        u, width = matrix.shape
        prefix = np.zeros((width + 1, u), np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * kernel.BASE + matrix[:, i] + np.uint64(1)
        power = [np.uint64(pow(int(kernel.BASE), k, 1 << 64)) for k in range(LONGEST + 1)]
        for start in range(width):
            for size in range(1, min(LONGEST, width - start) + 1):
                m = int(np.searchsorted(-lengths, -(start + size), "right"))
                if not m:
                    break
                if size == 1:
                    yield start, start + 1, slice(0, m), self.single[matrix[:m, start]]
                    continue
                code = (prefix[start + size, :m] - prefix[start, :m] * power[size]) * np.uint64(0x7FB5D329728EA185) + np.uint64(size)
                maybe = np.flatnonzero(self.seen[code >> np.uint64(44)])
                if len(maybe):
                    at = np.searchsorted(self.codes, code[maybe])
                    at[at == len(self.codes)] = 0
                    hit = self.codes[at] == code[maybe]
                    if hit.any():
                        yield start, start + size, maybe[hit], self.order[at[hit]]


def word_matrix(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (led by a blank), lengths, and the words' order, longest first."""
    lengths = ends - starts + 1
    order = np.argsort(-lengths, kind="stable")
    width = int(lengths.max(initial=1))
    at = starts[order][:, None] + np.arange(width - 1)
    inside = np.arange(width - 1) < (lengths[order] - 1)[:, None]
    out = np.zeros((len(starts), width), np.uint8)
    out[:, 0] = 32
    if width > 1:
        out[:, 1:] = np.where(inside, kernel.LOWER[raw[np.minimum(at, len(raw) - 1)]], 0)
    return out, lengths[order], order


def text_words(raw: np.ndarray, offsets: np.ndarray):
    """Hash, start, end, first word of rows; words are cut every CHUNK bytes."""
    cls = LETTER
    h, s, e, rows = kernel.words(raw, offsets, cls)
    if len(s) and int((e - s).max()) > CHUNK:
        n = -(-(e - s) // CHUNK)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s2 = np.repeat(s, n) + k * CHUNK
        e2 = np.minimum(s2 + CHUNK, np.repeat(e, n))
        h = kernel.mix(np.repeat(h, n) + k.astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(n)])
        rows, s, e = first[rows], s2, e2
    return h, s, e, rows


def forward(lattice: Lattice, p: np.ndarray, matrix, lengths) -> np.ndarray:
    """Log-probability of every word in every language; p is pieces by languages."""
    u, width = matrix.shape
    alpha = np.zeros((width + 1, u, p.shape[1]))
    alpha[0] = 1
    for start, end, w, piece in lattice.places(matrix, lengths):
        alpha[end, w] += alpha[start, w] * p[piece]
    return np.log(alpha[lengths, np.arange(u)] + 1e-300)


def learn(texts: list[str], langs: list[str], vocabulary: list[bytes], rounds: int = 4, smooth: float = 0.05) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities (pieces by languages) and log priors."""
    names = sorted(set(langs))
    of = np.array([names.index(x) for x in langs])
    raw, offsets = kernel.utf8(pa.array(texts, pa.large_string()))
    h, s, e, rows = text_words(raw, offsets)
    unique, first, back = np.unique(h, return_index=True, return_inverse=True)
    lang = np.repeat(of, np.diff(rows))
    counts = np.bincount(back * len(names) + lang, minlength=len(unique) * len(names)).reshape(len(unique), len(names)).astype(float)
    matrix, lengths, order = word_matrix(raw, s[first], e[first])
    counts = counts[order]
    lattice, v, n = Lattice(vocabulary), len(vocabulary), len(names)
    p = np.full((v, n), 1.0 / v)
    u = len(unique)
    blocks = []  # of words, so that the lattice's sums never cover all words at once
    for a in range(0, u, BLOCK):
        m, size = matrix[a : a + BLOCK, : int(lengths[a])], lengths[a : a + BLOCK]
        blocks.append((counts[a : a + BLOCK], size, list(lattice.places(m, size))))
    for _ in range(rounds if u else 0):
        expected = np.zeros((v, n))
        for count, size, places in blocks:
            m, width = len(size), int(size[0])
            alpha, beta = np.zeros((width + 1, m, n)), np.zeros((width + 1, m, n))
            alpha[0] = 1
            for start, end, w, piece in places:
                alpha[end, w] += alpha[start, w] * p[piece]
            beta[size, np.arange(m)] = 1
            for start, end, w, piece in sorted(places, key=lambda x: -x[0]):
                beta[start, w] += beta[end, w] * p[piece]
            scale = count / (alpha[size, np.arange(m)] + 1e-300)
            for start, end, w, piece in places:
                share = alpha[start, w] * p[piece] * beta[end, w] * scale[w]
                for k in range(n):
                    expected[:, k] += np.bincount(piece, share[:, k], v)
        p = (expected + smooth) / (expected.sum(0) + smooth * v)
    share = np.bincount(of, minlength=n).astype(float)
    return names, p, np.log(share / share.sum())


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """About ``per_language`` (text, lang) rows of each language, chosen by a hash of the id."""
    known = docs.where("text is not null and lang is not null").where(crc_bucket("doc_id", 4) != 2)
    counts = known.groupBy("lang").count().toPandas()  # a row for each language
    if not len(counts):
        return known.select("text", "lang").limit(0)
    share = F.create_map(*[F.lit(x) for lang, c in zip(counts["lang"], counts["count"], strict=True) for x in (lang, min(1.0, per_language / c))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return known.where(u < F.element_at(share, F.col("lang"))).select("text", "lang")


def learned(docs: DataFrame, vocabulary: Broadcast, per_language: int = SAMPLE) -> tuple[list[str], np.ndarray | None, np.ndarray | None]:
    """What ``learn`` gives for the sample. One task learns from it, so that the driver holds the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            rows = pa.Table.from_batches(found)
            model = learn(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), vocabulary.value)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample(docs, per_language).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else ([], None, None)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    alpha = np.zeros(256, bool)
    alpha[65:91] = alpha[97:123] = True
    sums = np.concatenate([[0], np.cumsum(alpha[raw])])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for r in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[r] = any(map(str.isalpha, raw[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")))
    return out


class Identifier:
    """The model learned from ``docs``, sent to all tasks."""

    def __init__(self, docs: DataFrame, vocabulary_path: str = VOCABULARY, per_language: int = SAMPLE):
        vocabulary = docs.sparkSession.sparkContext.broadcast(pieces(vocabulary_path))
        self.model = docs.sparkSession.sparkContext.broadcast(learned(docs, vocabulary, per_language))
        self.vocabulary, self.lattice = vocabulary, None

    def __getstate__(self):
        return self.model, self.vocabulary

    def __setstate__(self, state):
        (self.model, self.vocabulary), self.lattice = state, None

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language (``und`` without a letter) and posterior of each row."""
        names, p, prior = self.model.value
        n = len(offsets) - 1
        if not names:
            return ["und"] * n, np.zeros(n)
        self.lattice = self.lattice or Lattice(self.vocabulary.value)
        h, s, e, rows = text_words(raw, offsets)
        total = np.zeros((n, len(names)))
        if len(h):
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            matrix, lengths, order = word_matrix(raw, s[first], e[first])
            logs = np.empty((len(first), len(names)))
            for a in range(0, len(first), 20_000):
                b = min(a + 20_000, len(first))
                logs[order[a:b]] = forward(self.lattice, p, matrix[a:b, : int(lengths[a])], lengths[a:b])
            row = np.repeat(np.arange(n), np.diff(rows))
            for k in range(len(names)):
                total[:, k] = np.bincount(row, logs[back, k], n)
        total += prior
        best = total.argmax(1)
        known = has_letter(raw, offsets)
        score = np.where(known, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0)
        return [names[b] if k else "und" for b, k in zip(best, known, strict=True)], score


def identify(docs: DataFrame, vocabulary_path: str = VOCABULARY, per_language: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of the prediction)."""
    model = Identifier(docs, vocabulary_path, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in kernel.slices(batches, "text"):
            pred, score = model.predict(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose language is found with a posterior of ``least`` or more; others go. Each row is decided by its own text."""
    model = Identifier(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in kernel.slices(batches, "text"):
            pred, score = model.predict(raw, offsets)
            yield batch.filter(pa.array((np.array(pred) != "und") & (score >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark, sf_dir) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
