"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over token positions; positions it ignores may differ. The
masks' hashes of the benchmark's items are joined with those of all texts. Around a
hit, item and text are laid on the hit's diagonal: it is a leak from ``least`` equal
tokens on, or from four fifths of a shorter item's, counted over the whole item.
Reported is the best stretch (a match counts 1, a substitution -3) if it has as many,
else all from the first to the last equal token.

Items of up to LOSSLESS tokens have masks of their own besides: the item is cut into
two parts more than a fifth of its tokens, and a mask holds two of the parts, so that
some mask fits wherever a fifth of the tokens differ or lie beyond the text's end.

Tokens are runs of ASCII letters, digits and bytes above 127, A-Z lowered. Items of
fewer than 5 tokens leak where all their tokens stand in a row; an item without a token
leaks nowhere. The benchmark is taken in blocks of a bounded number of items, each sent
to all tasks with one pass over the texts, so it may be of any size. Null and empty
texts have no leak; null ids are carried; repeated rows each have their leaks;
``keep_clean`` decides each row by its own text and carries all columns, ``find_leaks``
ignores other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import table

#: Of 11 positions, 7 count; in the last, which misses no substitution of every fifth token, 9.
MASKS = ("11101100101", "11010110011", "10111001011", "11110111101")
SPAN, LOSSLESS = 11, 19
BLOCK = 20_000
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, matched long, share double"


def seeds(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The mask's hash at every token that ``len(mask)`` tokens begin at."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt * 0x9E3779B1 + 1))
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k : k + n] * np.uint64(0xA0761D6478BD642F * (2 * k + 3) % (1 << 64) | 1)
    return kernel.mix(out)


def masks_of(n: int) -> list[tuple[int, str, range]]:
    """Salt and mask of every seed of an item of ``n`` tokens, and the item's tokens that it begins at."""
    found = [(k, m, range(n - SPAN + 1)) for k, m in enumerate(MASKS)] if n >= SPAN else []
    if 1 <= n <= LOSSLESS:
        parts = n // 5 + 2
        cuts = [k * n // parts for k in range(parts + 1)]
        for i, j in combinations(range(parts), 2):
            size, gap = cuts[i + 1] - cuts[i], cuts[j] - cuts[i + 1]
            mask = "1" * size + "0" * gap + "1" * (cuts[j + 1] - cuts[j])
            found.append((len(MASKS), mask, range(cuts[i], cuts[i] + 1)))
    return found


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        raw, offsets = kernel.utf8(pa.array([t or "" for _, t in items], pa.large_string()))
        h, _, _, rows = kernel.words(raw, offsets, kernel.WORD_BYTE)
        self.ids, self.tokens = [i for i, _ in items], [h[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self.least = least
        found: dict[tuple[int, str], list] = {}
        for r, tokens in enumerate(self.tokens):
            for m in masks_of(len(tokens)):
                at = np.asarray(m[2])
                found.setdefault(m[:2], []).append((seeds(tokens, m[1], m[0])[at], np.full(len(at), r), at))
        self.tables = {}
        for m, parts in found.items():
            s, r, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(s, kind="stable")
            self.tables[m] = (s[order], r[order], p[order])

    def leaks(self, hashes: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first token, tokens, matches): the leak with the most matches of each row and item."""
        hits = set()
        for (salt, mask), (codes, items, places) in self.tables.items():
            s = seeds(hashes, mask, salt)
            at = np.flatnonzero(kernel.member(s, codes))
            row = np.searchsorted(rows, at, "right") - 1
            whole = at + len(mask) <= rows[row + 1]
            at, row = at[whole], row[whole]
            lo, hi = np.searchsorted(codes, s[at], "left"), np.searchsorted(codes, s[at], "right")
            n = hi - lo
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hits.update(zip(np.repeat(row, n).tolist(), items[k].tolist(), (np.repeat(at, n) - places[k]).tolist(), strict=True))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, shift in sorted(hits):
            tokens = self.tokens[item]
            a, b = max(int(rows[row]), shift), min(int(rows[row + 1]), shift + len(tokens))
            same = hashes[a:b] == tokens[a - shift : b - shift]
            least = min(self.least, -(-4 * len(tokens) // 5))
            if same.sum() < least:
                continue
            score = np.cumsum(np.where(same, 1, -3))
            low = np.minimum.accumulate(np.concatenate([[0], score[:-1]]))
            end = int((score - low).argmax())
            start = int(np.flatnonzero(np.concatenate([[0], score[:end]]) == low[end])[-1])
            matched = int(same[start : end + 1].sum())
            if matched < least:
                start, end = (int(x) for x in np.flatnonzero(same)[[0, -1]])
                matched = int(same.sum())
            if matched > best.get((row, item), (0,))[0]:
                best[row, item] = (matched, a + start - int(rows[row]), end + 1 - start)
        return [(row, item, start, n, matched) for (row, item), (matched, start, n) in sorted(best.items())]


def blocks(benchmark: DataFrame, least: int) -> Iterator[Broadcast]:
    """The indexes of the benchmark's blocks, one after the other; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    n = -(-items.count() // BLOCK)
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows.collect()], least))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 13) -> DataFrame:
    """doc_id, item_id, start_word, n_words, matched, share (of the item's tokens): a row for each text and item that leaks into it."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = [_against(docs, index) for index in blocks(benchmark, least)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def _against(docs: DataFrame, index: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in kernel.slices(batches, "text"):
            h, _, _, rows = kernel.words(raw, offsets, kernel.WORD_BYTE)
            if found := index.value.leaks(h, rows):
                ids, items = batch.column(0), index.value
                cols = [[ids[r].as_py() for r, *_ in found], [items.ids[i] for _, i, *_ in found], *([x[k] for x in found] for k in (2, 3, 4)), [x[4] / len(items.tokens[x[1]]) for x in found]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.float64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = 13) -> DataFrame:
    """Rows into whose text no item leaks."""
    for index in blocks(benchmark, least):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch, raw, offsets in kernel.slices(batches, "text"):
                h, _, _, rows = kernel.words(raw, offsets, kernel.WORD_BYTE)
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in index.value.leaks(h, rows)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
