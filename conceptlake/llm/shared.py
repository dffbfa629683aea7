"""What several operators share: tables in the shared folder, global ranks, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where a local session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(spark, "_conceptlake_dir", None) or "file://" + tempfile.mkdtemp(prefix="conceptlake-")
        spark._conceptlake_dir = path
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/conceptlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


#: Tables that are still there.
_tables: list[tuple[SparkSession, str]] = []


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote; nothing that is still to be computed may read them."""
    _delete({t._table for t in tables})


def _delete(paths: set[str]) -> None:
    for spark, path in [x for x in _tables if x[1] in paths]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _tables.remove((spark, path))


def tables_now() -> set[str]:
    """The tables that ``materialize`` has written and nobody has dropped."""
    return {path for _, path in _tables}


def drop_since(before: set[str]) -> None:
    """Deletes the tables that aren't in ``before``."""
    _delete(tables_now() - before)


@atexit.register
def _at_exit() -> None:
    try:
        _delete(tables_now())
    except Exception:  # the session may be gone
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_bucket(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


def with_rank(df: DataFrame, key: str, out: str, parts: int = 0) -> DataFrame:
    """Distinct non-null values of ``key`` with their 0-based rank, without a single-task sort.

    Ranges are cut by Spark, ranks are local to a range and shifted by the
    number of values in lower ranges; only one row per range is summed in one task.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranged = materialize(keys.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    sums = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_shift"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    return local.join(shift, "_part").select(key, (F.col("_local") + F.col("_shift")).cast("long").alias(out))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of ``edges(u, v)``: root is the smallest vertex reachable.

    Alternating large-star and small-star rounds; every round is a few
    aggregations and equi-joins on tables in the shared folder.
    Self loops count as vertices, nulls are dropped, repeated edges don't matter.
    """
    edges = edges.where("u is not null and v is not null")
    alone = edges.where("u = v").select("u")
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialize(small)
        drop(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    rooted = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    done = rooted.union(roots)
    lone = alone.distinct().join(done.select(F.col("id").alias("u")), "u", "left_anti").select(F.col("u").alias("id"), F.col("u").alias("root"))
    return done.union(lone)
