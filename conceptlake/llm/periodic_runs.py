"""Periodic runs of words by Ellert and Fischer's linear-time algorithm.

A run is a maximal stretch of words with a smallest period that fits into it often
enough. For an order of the words and its reverse, every suffix gets its next smaller
suffix (the Lyndon array) together with the number of words that the two share. The
comparisons are made from left to right; the one that has matched farthest is kept:
inside its match, a comparison has the outcome of its image at the earlier place, and
one that would leave the match goes on where the match ended. So each word is matched
once, without suffix arrays, trees or hashes. A run's leftmost Lyndon root and its
next smaller suffix are one period apart, and their common words end where the run ends;
what remains to the left is less than a period.

Before that, places that can't hold a wanted run are left out. In a run of period q all
words but the last q come again within q words, so that at least ``min_length - q`` and
``(min_exponent - 1) * q`` words in a row do. For q up to each power of two only
stretches of words that return so soon, lengthened by that power, are searched; no run
is lost, and prose is mostly passed over with one sort of its word numbers.

Rows: null, empty and blank texts have no words and no runs. Ids may be null or repeat:
each row is treated by itself. Other columns are ignored (or carried, see ``carry``). An
empty table gives an empty result. A text is never cut: it is one task's as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import table

RUNS = "array<struct<start: long, length: long, period: long>>"
FAR = np.int64(1) << 60


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """Of every suffix, the start of the next smaller one (their number if there is none), and how many symbols both share."""
    n = len(x)
    nss, shared = [n] * n, [0] * n
    pss, shared_pss = [-1] * n, [0] * n
    stack = [0] if n else []
    left = right = reach = 0  # the pair that has matched farthest, and where its match ends
    for r in range(1, n):
        inside, d = r < reach, right - left
        popped, m = -1, 0
        while stack:
            at = stack[-1]
            if popped >= 0:  # at is the previous smaller suffix of the popped one
                start = shared_pss[popped]
                scan = start == m
                m = min(start, m)
            elif inside:
                m = shared[at - d] if nss[at - d] == r - d else shared_pss[r - d]
                scan = m >= reach - r
                m = min(m, reach - r)
            else:
                m, scan = 0, True
            if scan:
                while r + m < n and x[at + m] == x[r + m]:
                    m += 1
                if r + m >= reach:
                    left, right, reach = at, r, r + m
            if r + m < n and x[at + m] < x[r + m]:
                pss[r], shared_pss[r] = at, m
                break
            nss[at], shared[at] = r, m
            if scan or popped >= 0:
                popped = at
            stack.pop()
        stack.append(r)
    return nss, shared


def runs_of(x: list[int], min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``x`` with length >= max(min_length, min_exponent * period); min_exponent is 3 or more."""
    found = set()
    for y in (x, [-v for v in x]):
        nss, shared = next_smaller(y)
        for a, b in enumerate(nss):
            p, m = b - a, shared[a]
            if m < p or b - a + m + p - 1 < max(min_length, min_exponent * p):
                continue
            if a >= p and nss[a - p] == a and shared[a - p] == m + p:
                continue  # not the leftmost root
            k = 0
            while k < a and k < p and x[a - k - 1] == x[b - k - 1]:
                k += 1
            if k < p and b - a + m + k >= max(min_length, min_exponent * p):
                found.add((a - k, p + m + k, p))
    return found


def stretches(x: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Disjoint ranges of ``x`` (rows begin at ``first``) outside which no run lies; a run lies in one of them, with the words beside it."""
    n, rows = len(x), len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.argsort(x, kind="stable")
    again = np.full(n, FAR)
    same = (x[order[1:]] == x[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    longest, q, found = int(np.diff(first).max(initial=0)), 8, []
    while q // 2 < longest // min_exponent + 1:
        ends = np.concatenate([[-1], np.flatnonzero(again > q)])
        # periods in (q / 2, q], for the first q all up to it
        least = max(min_length - q, (min_exponent - 1) * (q // 2) if q > 8 else 1)
        hit = np.flatnonzero(np.diff(ends) - 1 >= least)
        found += [(int(a) + 1, int(b) + q) for a, b in zip(ends[hit], ends[hit + 1], strict=True)]
        q *= 2
    merged: list[list[int]] = []
    for a, b in sorted(found):
        end = int(first[row[a] + 1])
        b = min(b, end)
        if merged and a <= merged[-1][1] and row[a] == row[merged[-1][0]]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(max(int(first[row[a]]), a - 1), min(int(first[row[a] + 1]), b + 1)) for a, b in merged]


def runs_of_rows(x: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Each row's runs, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    for a, b in stretches(x, first, min_length, min_exponent):
        r = int(np.searchsorted(first, a, "right")) - 1
        out[r] += [(s + a - int(first[r]), length, p) for s, length, p in runs_of(x[a:b].tolist(), min_length, min_exponent)]
    return [sorted(r, key=lambda v: (v[0], v[2])) for r in out]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the rows, and each row's first (one more entry than rows); nulls have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "").cast(pa.large_string())))
    flat, at = lists.values, lists.offsets.to_numpy().astype(np.int64)
    flat, at = flat.slice(at[0], at[-1] - at[0]), at - at[0]
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not some.all():  # an empty text splits into one empty word
        at = np.concatenate([[0], np.cumsum(some)])[at]
        flat = flat.filter(pa.array(some))
    return flat, at


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = 24, min_exponent: int = 3, repeated: Callable[[int, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """id, n_words, runs (by start, then period), collapsed: the words that no run holds after its first period, joined by one space.

    ``repeated(id, words)`` may give a place and a period from which on a text's words
    are replaced by repetitions before the search (None: it stays as it is).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in kernel.slices(batches, "text"):
            words, first = split_words(batch.column(1))
            take = np.arange(len(words))
            if repeated is not None:
                for r, key in enumerate(batch.column(0).to_pylist()):
                    n = int(first[r + 1] - first[r])
                    if key is not None and n and (how := repeated(key, n)) is not None:
                        a, p = how
                        take[first[r] + a : first[r + 1]] = first[r] + a + np.arange(n - a) % p
            x = words.dictionary_encode().indices.to_numpy()[take]
            found = runs_of_rows(x, first, min_length, min_exponent)
            keep = np.ones(len(x), bool)
            for r, runs in enumerate(found):
                for s, length, p in runs:
                    keep[first[r] + s + p : first[r] + s + length] = False
            kept = np.concatenate([[0], np.cumsum(keep)])[first]
            left = words.take(pa.array(take[keep]))
            collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), left), pa.scalar(" ", pa.large_string()))
            lists = [[{"start": s, "length": length, "period": p} for s, length, p in runs] for runs in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(lists, kind), collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("doc_id", id_col)


def crc_repetition(key: int, n: int) -> tuple[int, int] | None:
    """The query's rule: a tenth of the ids, by checksum, repeat from some word on."""
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op13_periodic_runs(spark, sf_dir) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), repeated=crc_repetition)
    best = F.expr("reduce(slice(runs, 2, size(runs)), get(runs, 0), (best, x) -> if(x.length * best.period > best.length * x.period, x, best))")
    lines = "array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')"
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr(f"sha2({lines}, 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
