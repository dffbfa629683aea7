"""An approximate index for cosine search: vectors in cells around centroids, a search reads the nearest cells alone.

Cells come from rounds of k-means over all vectors, each one pass in which tasks send sums by cell; the driver holds the
centroids (at most CELLS_MOST times the vectors' length). The vectors are written once, partitioned by cell, so a search
prunes the other cells' files before it reads, and ranks what it reads by the exact distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptlake.operators import vector as V
from conceptlake.tables import shared_path

CELLS_MOST = 4096
#: Vectors without a direction (null, zero, other lengths) lie in a cell of their own, which every search reads.
NO_CELL = -1


def _units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one."""
    rows = column.to_pylist()
    x = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        if v is not None and len(v) == dims and None not in v:
            x[i] = v
    norm = np.linalg.norm(x, axis=1)
    some = np.isfinite(norm) & (norm > 0)
    return np.where(some[:, None], x / np.where(some, norm, 1)[:, None], 0), some


class CellIndex:
    """vectors(id, embedding, ...) in ``cells`` cells (the root of their number, if none is given)."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, rounds: int = 5):
        self.spark, self.schema = vectors.sparkSession, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])
        sizes = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
        self.dims = sizes.dims if sizes else 1
        k = min(CELLS_MOST, cells or max(1, round((sizes.n if sizes else 0) ** 0.5)))
        # the first centroids are vectors in the order of a hash, the same in every run
        usable = vectors.where((F.size("embedding") == self.dims) & ~V.is_zero(F.col("embedding")))
        first = usable.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(k).collect()
        self.centroids, some = _units(pa.array([r.embedding for r in first], pa.list_(pa.float64())), self.dims)
        self.centroids = self.centroids[some]
        for _ in range(rounds if len(self.centroids) else 0):
            sums, counts = np.zeros_like(self.centroids), np.zeros(len(self.centroids))
            for r in self._sums(vectors).collect():
                sums[r.cell], counts[r.cell] = r.sums, r.n
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), self.centroids)
        self.path = f"{shared_path(self.spark)}/cells-{uuid.uuid4().hex}"
        self._assigned(vectors).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(self.path)

    def _assigned(self, vectors: DataFrame) -> DataFrame:
        centroids, dims, at = self.centroids, self.dims, vectors.columns.index("embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, some = _units(b.column(at), dims)
                cell = (x @ centroids.T).argmax(axis=1) if len(centroids) else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(some & bool(len(centroids)), cell, NO_CELL), pa.int32())], [*b.schema.names, "cell"])

        return vectors.mapInArrow(run, self.schema)

    def _sums(self, vectors: DataFrame) -> DataFrame:
        centroids, dims = self.centroids, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for b in batches:
                x, some = _units(b.column(0), dims)
                cell = (x[some] @ centroids.T).argmax(axis=1)
                np.add.at(sums, cell, x[some])
                counts += np.bincount(cell, minlength=len(counts))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], ["cell", "n", "sums"])

        rows = vectors.select("embedding").mapInArrow(run, "cell long, n long, sums array<double>")
        each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
        return rows.groupBy("cell").agg(F.sum("n").alias("n"), *each).select("cell", "n", F.array(*(F.col(f"s{i}") for i in range(dims))).alias("sums"))

    def near(self, query: list[float], probes: int) -> DataFrame:
        """The vectors of the ``probes`` cells nearest to a query, and of those without a direction."""
        cells = np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable")[:probes].tolist() if len(self.centroids) else []
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("cell").isin([NO_CELL, *cells]))

    def knn(self, query: list[float], k: int = 5, probes: int = 8, where: Column | None = None) -> DataFrame:
        """id, distance of the nearest ``k`` among the probed cells; all cells give the exact answer. A filter applies before ranking."""
        return V.knn(self.near(query, probes), query, k, where)
