"""Exact cosine search over vectors(id, embedding, ...), filters, rerank, hybrid search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conceptlake.functions import text as X
from conceptlake.operators import graph


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def knn(vectors: DataFrame, query: list[float], k: int = 5, where: Column | None = None) -> DataFrame:
    """id, distance of the nearest ``k``; a filter applies before ranking."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select("id", cosine_distance(F.col("embedding"), q).alias("distance")).orderBy(F.asc_nulls_last("distance"), "id").limit(k)


#: Queries that are sent to every task at a time.
BLOCK = 1000


def knn_many(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, distance for each of queries(query_id, query).

    The queries go to all tasks in blocks of a bounded number, each with one pass over the vectors; a task keeps its own
    nearest ``k`` of a query before the shuffle.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    found = []
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        pairs = vectors.crossJoin(F.broadcast(block.select("query_id", "query"))).select("query_id", "id", cosine_distance(F.col("embedding"), F.col("query")).alias("distance"))
        by = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
        found.append(pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance"))
    return reduce(DataFrame.unionByName, found)


def search_many(vectors: DataFrame, queries: DataFrame, score: Column, k: int = 5, keep: int | None = None) -> DataFrame:
    """The pooled form of ``search``: 3k hits of each query, one row a vector, ranked together by one score."""
    hits = knn_many(vectors, queries, 3 * k).groupBy("id").agg(F.min("distance").alias("distance"))
    return rerank(vectors.drop("distance").join(hits, "id"), score, keep or k)


def overlap_score(query: str, text: Column) -> Column:
    """Share of the query's words that the text has: a deterministic stand-in for a model."""
    words = F.array_distinct(F.split(F.lower(F.lit(query)), " "))
    return F.size(F.array_intersect(words, F.split(F.lower(text), r"\W+"))) / F.size(words)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The hits by score, then former order; their distance becomes 1 - score."""
    return hits.withColumn("score", score).orderBy(F.desc("score"), "distance", "id").limit(k).withColumn("distance", 1 - F.col("score"))


def search(vectors: DataFrame, query: list[float], score: Column, k: int = 5) -> DataFrame:
    """Fetches 3k by distance, keeps k by score."""
    found = knn(vectors, query, 3 * k)
    return rerank(vectors.drop("distance").join(F.broadcast(found), "id"), score, k)


def embed(df: DataFrame, text: str = "text", dims: int = 64) -> DataFrame:
    """Feature hashing of words, L2-normalised: an offline stand-in for an embedding model. Null and empty texts have the zero vector."""

    @F.pandas_udf("array<float>")
    def counted(slots: pd.Series) -> pd.Series:
        sizes = slots.map(len).to_numpy()
        row = np.repeat(np.arange(len(slots)), sizes)
        flat = np.concatenate(slots.to_list()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        counts = np.bincount(row * dims + flat, minlength=len(slots) * dims).reshape(-1, dims).astype(float)
        norm = np.sqrt((counts * counts).sum(1, keepdims=True))
        return pd.Series(list((counts / np.where(norm > 0, norm, 1)).astype(np.float32)))

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\W+"), lambda w: w != "")
    return df.withColumn("embedding", counted(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))))


def health(vectors: DataFrame, dims: int) -> DataFrame:
    return vectors.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != dims).alias("wrong_size"), F.count_if(is_zero(F.col("embedding"))).alias("zero"))


def hybrid_chunks(vectors: DataFrame, query: list[float], edges: DataFrame, nodes: DataFrame, k: int = 5, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """What a reader is shown: the nearest chunks with snippet and relevance, and the concepts reached with their names, strongest first."""
    hits = vectors.drop("distance").join(F.broadcast(knn(vectors, query, k)), "id")  # k rows
    shown = hits.select("id", X.snippet(F.col("text")).alias("snippet"), X.relevance(F.col("distance")).alias("relevance")).orderBy(F.desc("relevance"), "id")
    near = hybrid(vectors, query, edges, k, hops).join(nodes.select("id", "name"), "id").orderBy(F.desc("relevance"), "id")
    return shown, near


def hybrid(vectors: DataFrame, query: list[float], edges: DataFrame | graph.Adjacency, k: int = 5, hops: int = 2) -> DataFrame:
    """id, relevance of the concepts reached from the concepts of the nearest vectors (vectors has concept_id); one lazy plan, if the edges are no adjacency table."""
    seeds = vectors.select("id", "concept_id").join(F.broadcast(knn(vectors, query, k)), "id").select(F.col("concept_id").alias("id")).where("id is not null").distinct()
    return graph.reach(edges, seeds, hops).select(F.col("target").alias("id"), "relevance")
