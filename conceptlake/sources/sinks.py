"""Upserts without MERGE: a table's next state as a DataFrame, and its write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptlake.functions import text as X
from conceptlake.tables import cut


def upsert(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, values of ``delta`` that are not null win. A null in a key equals a null."""
    a, b = base.alias("a"), delta.alias("b")
    cols = [c for c in base.columns if c not in key]
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    return joined.select(*(F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in key), *((F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in delta.columns else F.col(f"a.{c}")).alias(c) for c in cols))


def first_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: the least in the order of its other columns (nulls first), whatever the partitioning."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*(F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns))


class KeyedTable:
    """A table whose rows lie in ``buckets`` partitions by a hash of their key, so that a merge reads and writes the touched ones alone.

    A merge computes the touched buckets' next state, keeps it in the shared folder, and then puts it in their place
    (dynamic partition overwrite); the files of other buckets stay as they are. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path, key, buckets, None

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.key)), F.lit(self.buckets)).cast("int"))

    def _write(self, placed: DataFrame) -> None:
        placed.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def create(self, df: DataFrame) -> KeyedTable:
        self.schema = df.schema
        self._write(self._placed(df))
        return self

    def _all(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().select(*self.schema.names)

    def touched(self, delta: DataFrame) -> list[int]:
        """The buckets that a delta's keys lie in: ``buckets`` numbers at most."""
        return sorted(r[0] for r in self._placed(delta).select("_bucket").distinct().collect())

    def merge(self, delta: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """Puts ``change(rows of the touched buckets, delta)`` in their place (an upsert, if none is given); the touched buckets."""
        buckets = self.touched(delta)
        if buckets:
            old = self._all().where(F.col("_bucket").isin(buckets)).select(*self.schema.names)
            new = change(old, delta) if change else upsert(old, delta, self.key)
            self._write(cut(self._placed(new.select(*self.schema.names))))
        return buckets


def insert_if_absent(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    return base.unionByName(first_rows(delta, key).join(base.select(*key), key, "left_anti"), allowMissingColumns=True)


def get_or_create(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Concept nodes for names that no node has, whatever their case."""
    new = names.select("name").dropDuplicates(["name"]).join(nodes.select(F.lower("name").alias("_k")).distinct(), F.lower("name") == F.col("_k"), "left_anti")
    return new.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("name")).select(F.concat(F.lit("concept-"), F.left(F.sha2("_k", 256), F.lit(16))).alias("id"), "name")


def merge_relations(base: DataFrame, delta: DataFrame) -> DataFrame:
    """(src, dst, type) with the largest strength; the later description and method. Odd types are left out."""
    rows = base.withColumn("_seq", F.lit(0)).unionByName(delta.withColumn("_seq", F.lit(1)), allowMissingColumns=True).where(F.col("type").rlike("^[A-Z_]+$"))
    return rows.groupBy("src", "dst", "type").agg(F.max("strength").alias("strength"), F.max_by("description", "_seq").alias("description"), F.max_by("method", "_seq").alias("method"))


def safe_label(label):
    return F.when(label.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), label).otherwise("Concept")


def resolve_endpoint(ref, nodes: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """The node id of a reference that is an id (``concept-`` first) or a name in any case."""
    names = nodes.groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("_id"))
    return rows.join(names, F.lower(ref) == F.col("_n"), "left").withColumn(out, F.when(ref.startswith("concept-"), ref).otherwise(F.col("_id"))).drop("_n", "_id")


def write_table(df: DataFrame, path: str, mode: str = "append", partition: str | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(partition) if partition else w).parquet(path)


def vector_rows(docs: DataFrame, text: str = "document") -> DataFrame:
    """Rows for a vector table: an id where there is none (of the text's hash), lists as strings, lower-case fields.

    Batches, retries and halving are Spark's work: a task that fails is run again on its part.
    """
    lists = {c for c, kind in docs.dtypes if kind == "array<string>"}
    made = F.concat(F.lit("doc_"), F.left(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), F.lit(16)))
    rows = docs.withColumn("id", F.coalesce(F.col("id").cast("string"), made) if "id" in docs.columns else made)
    return X.lower_fields(rows.withColumns({c: X.metadata_text(F.col(c)) for c in lists}))


def document_nodes(docs: DataFrame) -> DataFrame:
    """Document nodes of new documents: id, label, name (the title, or Untitled) and the fields that exist."""
    kept = [c for c in ("author", "source", "url", "publication_date", "category", "tags") if c in docs.columns]
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("Document").alias("label"), F.coalesce("title", F.lit("Untitled")).alias("name"), *kept)


def clear(spark: SparkSession, path: str) -> bool:
    """Deletes a table; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
