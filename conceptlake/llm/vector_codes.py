"""Compression of vectors to short codes: a codebook for each part, by Elkan's form of Lloyd's rounds.

A vector becomes integers and is cut into equal parts; each part is replaced by the number
of its codebook's nearest entry. Distances are compared as exact integers (ties go to
the lower number). Each part of a vector keeps an upper bound of the distance to its
entry and one lower bound for every entry; they are written to the shared folder with
the vector and shifted by how far entries moved in the meantime. An entry is passed over
only if its lower bound, or half its distance to the present entry, is strictly above
the upper bound, so pruning never decides a tie. Lower bounds are stored in steps of a
255th of the codebook's largest distance, rounded down (a byte each); upper bounds are
rounded up.

A round is one pass over the vectors where they lie: no vector is shuffled or joined,
tasks send sums by part and entry, and the driver holds codebooks alone
(``parts * entries`` entries whatever the number of vectors).

Rows: vectors that are null or hold nulls or non-finite components are dropped, and so
are those whose length isn't that of the smallest id's. A length that the parts don't
divide is filled up with zeros. Equal ids are rows of their own (as entries ordered by
their vectors); rows with a null id get codes but are no first entries. Without any
first entry nothing is returned. Components whose integer passes 2**27 raise an error:
sums of their squares would leave a long. Other columns are carried by
``compress``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialize, table

MOST = 1 << 27
#: Relative slack of every bound over rounding.
SLACK = 1e-6
#: Groups whose error sums are sent to every task if they are so few.
SENT_GROUPS = 100_000
STATE = "_ints binary, _code binary, _upper binary, _lower binary"


def integers(column: pa.Array, dims: int, parts: int, scale: int) -> np.ndarray:
    """(rows, parts, width) of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component's integer passes {MOST}")
    x = x.astype(np.int64).reshape(-1, dims)
    if dims % parts:
        x = np.concatenate([x, np.zeros((len(x), parts - dims % parts), np.int64)], axis=1)
    return x.reshape(len(x), parts, -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Codebooks:
    """Entries (parts, entries, width), what pruning needs of them, and how far they moved since the last ones."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None, step: np.ndarray | None = None):
        self.entries = entries
        apart = np.sqrt(squares(entries[:, :, None], entries[:, None]).astype(float))
        self.half = apart / 2 * (1 - SLACK)
        others = self.half + np.where(np.eye(entries.shape[1], dtype=bool), np.inf, 0)
        self.near = others.min(axis=2)
        self.moved = np.zeros(entries.shape[:2]) if moved is None else moved
        self.step = np.maximum(apart.max(axis=(1, 2)), 1) / 255 if step is None else step

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries become the floors of their parts' means; unused ones stay."""
        used = counts > 0
        new = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], self.entries)
        return Codebooks(new, np.sqrt(squares(new, self.entries).astype(float)) * (1 + SLACK), self.step)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(x: np.ndarray, books: Codebooks, code: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of (rows, parts, width): code, exact squared distance, upper and lower bounds, and the distances computed.

    ``lower`` counts steps; without a former state every bound begins at nothing.
    """
    n, parts, width = x.shape
    k = books.entries.shape[1]
    points, part = x.reshape(-1, width), np.tile(np.arange(parts), n)
    step = books.step[part]
    if code is None:
        a, low = np.zeros(n * parts, np.int64), np.zeros((n * parts, k), np.uint8)
        u = np.full(n * parts, np.inf)
    else:
        a = code.reshape(-1).astype(np.int64)
        u = upper.reshape(-1).astype(float) + books.moved[part, a]
        low = np.maximum(np.floor(lower.reshape(-1, k) - (books.moved / books.step[:, None] * (1 + SLACK))[part]), 0).astype(np.uint8)
    d2 = squares(points, books.entries[part, a])
    # a step down covers the rounding of the root
    steps = lambda v, s: np.clip(np.floor(np.sqrt(v.astype(float)) * (1 - SLACK) / s), 0, 255).astype(np.uint8)
    open_ = np.flatnonzero(~(u < books.near[part, a]))
    u[open_] = np.sqrt(d2[open_].astype(float)) * (1 + SLACK)
    low[open_, a[open_]] = steps(d2[open_], step[open_])
    open_ = open_[~(u[open_] < books.near[part[open_], a[open_]])]
    computed = n * parts
    for j in range(k):
        now, p = a[open_], part[open_]
        asked = open_[(now != j) & (u[open_] >= low[open_, j] * step[open_]) & (u[open_] >= books.half[p, now, j])]
        if not len(asked):
            continue
        computed += len(asked)
        other = squares(points[asked], books.entries[part[asked], j])
        low[asked, j] = steps(other, step[asked])
        better = (other < d2[asked]) | ((other == d2[asked]) & (j < a[asked]))
        won = asked[better]
        a[won], d2[won] = j, other[better]
        u[won] = np.sqrt(d2[won].astype(float)) * (1 + SLACK)
    return a.reshape(n, parts), d2.reshape(n, parts), u.reshape(n, parts), low.reshape(n, parts, k), computed


def _binary(x: np.ndarray) -> pa.Array:
    """A row's values as bytes."""
    x = np.ascontiguousarray(x).reshape(len(x), -1)
    wide = x.shape[1] * x.itemsize
    at = np.arange(len(x) + 1, dtype=np.int64) * wide
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)]).cast(pa.binary())


def _values(column: pa.Array, kind, n: int, *shape: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(n, *shape) if n else np.zeros((0, *shape), kind)


class Compressor:
    """Codebooks of ``parts`` positions with ``entries`` entries over a table of vectors."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, scale: int = 256):
        self.parts, self.scale, self.rest = parts, scale, [c for c in vectors.columns if c != vector]
        finite = "{v} is not null and size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))".format(v="_vector")
        kept = vectors.select(*(F.col(f"`{c}`") for c in self.rest), F.col(f"`{vector}`").cast("array<double>").alias("_vector")).where(finite)
        first = kept.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), "_vector").orderBy("_id", "_vector")
        found = first.limit(1).collect()
        self.dims = len(found[0]._vector) if found else 0
        self.kept = kept.where(F.size("_vector") == self.dims)
        seeds = [r._vector for r in first.where(F.size("_vector") == self.dims).limit(entries).collect()] if found else []
        x = integers(pa.array(seeds, pa.list_(pa.float64())), self.dims, parts, scale) if seeds else np.zeros((0, parts, 1), np.int64)
        self.books = Codebooks(np.ascontiguousarray(x.transpose(1, 0, 2))) if seeds else None
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.kept.schema if f.name != "_vector")

    def _assigned(self, state: DataFrame | None, last: bool) -> DataFrame:
        books, parts, dims, scale, rest, begins = self.books, self.parts, self.dims, self.scale, len(self.rest), state is None
        k, width = books.entries.shape[1:]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    b = batch.slice(at, 2000)
                    n, given = b.num_rows, [b.column(i) for i in range(rest)]
                    if begins:
                        x, former = integers(b.column(rest), dims, parts, scale), ()
                    else:
                        x = _values(b.column(rest), np.int32, n, parts, width).astype(np.int64)
                        former = (_values(b.column(rest + 1), np.int16, n, parts), _values(b.column(rest + 2), np.float32, n, parts), _values(b.column(rest + 3), np.uint8, n, parts, k))
                    code, d2, upper, lower, _ = assign(x, books, *former)
                    if last:
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(code.ravel(), pa.int32()))
                        yield pa.RecordBatch.from_arrays([*given, lists, pa.array(d2.sum(axis=1))], [*b.schema.names[:rest], "codes", "error"])
                    else:
                        up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
                        made = [_binary(x.astype(np.int32)), _binary(code.astype(np.int16)), _binary(up), _binary(lower)]
                        yield pa.RecordBatch.from_arrays([*given, *made], [*b.schema.names[:rest], "_ints", "_code", "_upper", "_lower"])

        return (self.kept if state is None else state).mapInArrow(run, ", ".join(x for x in (self.schema, "codes array<int>, error long" if last else STATE) if x))

    def _sums(self, state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Componentwise sums and counts of the parts at every entry."""
        parts, (_, k, width) = self.parts, self.books.entries.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
            for b in batches:
                x = _values(b.column(0), np.int32, b.num_rows, parts, width).reshape(-1, width)
                at = (_values(b.column(1), np.int16, b.num_rows, parts) + np.arange(parts) * k).ravel()
                counts += np.bincount(at, minlength=parts * k)
                for w in range(width):  # exact: a batch's sums stay below 2**53
                    sums[:, w] += np.bincount(at, weights=x[:, w], minlength=parts * k).astype(np.int64)
            used = np.flatnonzero(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists], ["at", "n", "sums"])

        rows = state.select("_ints", "_code").mapInArrow(run, "at long, n long, sums array<long>")
        each = [F.sum(F.col("sums")[w]).alias(f"s{w}") for w in range(width)]
        sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for r in rows.groupBy("at").agg(F.sum("n").alias("n"), *each).collect():  # parts * entries rows
            counts[r["at"]], sums[r["at"]] = r["n"], [r[f"s{w}"] for w in range(width)]
        return sums.reshape(parts, k, width), counts.reshape(parts, k)

    def compress(self, rounds: int = 2) -> DataFrame:
        """The kept rows' other columns with ``codes`` (entry numbers, 0-based, in part order) and ``error`` (sum of squared distances)."""
        if self.books is None:
            return self.kept.where("false").drop("_vector").selectExpr("*", "cast(null as array<int>) as codes", "cast(null as long) as error")
        state = None
        for _ in range(rounds):
            last, state = state, materialize(self._assigned(state, last=False))
            if last is not None:
                drop(last)
            self.books = self.books.updated(*self._sums(state))
        out = materialize(self._assigned(state, last=True))
        if state is not None:
            drop(state)
        return out


def with_group_error(rows: DataFrame, group: str) -> DataFrame:
    """Adds ``<group>_error``: the error summed over equal values of ``group``, nulls together."""
    name = f"{group}_error"
    totals = materialize(rows.groupBy(F.col(group).alias("_group")).agg(F.sum("error").alias(name)))
    few = totals.count() <= SENT_GROUPS
    return rows.join(F.broadcast(totals) if few else totals, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def op11_vector_codes(spark, sf_dir) -> DataFrame:
    made = Compressor(table(spark, sf_dir, "embeddings"))
    rows = with_group_error(made.compress(), "label")
    sha = made.books.sha256() if made.books is not None else hashlib.sha256(b"").hexdigest()
    code = F.expr("array_join(transform(codes, c -> lower(lpad(hex(c), 2, '0'))), '')")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql() -> str:
    """Two rounds spelled out: every part against every entry."""
    axes = "abcd"
    floor = lambda c: f"(sum({c}) - ((sum({c}) % count(*)) + count(*)) % count(*)) // count(*)"
    far = " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in axes)
    rounds = ""
    for r in range(3):
        rounds += f""",
near{r} AS MATERIALIZED (SELECT x.row, x.p, min(({far}) * 64 + y.e) AS m FROM parts x JOIN book{r} y ON x.p = y.p GROUP BY 1, 2)"""
        if r < 2:
            rounds += f""",
mean{r} AS (SELECT p, m % 64 AS e, {", ".join(f"({floor(c)})::BIGINT AS {c}" for c in axes)} FROM near{r} JOIN parts USING (row, p) GROUP BY 1, 2),
book{r + 1} AS MATERIALIZED (SELECT o.p, o.e, {", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in axes)} FROM book{r} o LEFT JOIN mean{r} n ON o.p = n.p AND o.e = n.e)"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, {", ".join(f"v[4 * p + {i + 1}] AS {c}" for i, c in enumerate(axes))} FROM kept, range(16) AS r(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, {", ".join(axes)} FROM parts WHERE row <= 64){rounds},
coded AS (SELECT row, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM near2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', {", ".join(axes)}), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


OP11_SQL = _sql()
