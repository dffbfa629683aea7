"""Model plug-ins: the protocol, a deterministic stand-in, and a fallback wrapper."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptlake.functions import chunks as C
from conceptlake.functions import text as X
from conceptlake.operators import concepts as K


class Provider(Protocol):
    def generate(self, prompt: str) -> str: ...

    def generate_batch(self, prompts: list[str]) -> list[str]: ...

    def embeddings(self, texts: list[str]) -> list[list[float]]: ...


class Offline:
    """Replies and vectors from a hash of the input."""

    def generate(self, prompt: str) -> str:
        return hashlib.sha256(prompt.encode()).hexdigest()

    def generate_batch(self, prompts: list[str]) -> list[str]:
        return [self.generate(p) for p in prompts]

    def embeddings(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()] for t in texts]


class Fallback:
    """Asks the second provider where the first one's reply is an error or its vectors are zero; a batch stays with the second after the first failure."""

    def __init__(self, first: Provider, second: Provider):
        self.first, self.second = first, second

    @staticmethod
    def failed(reply: str) -> bool:
        return reply.startswith(("Error:", "API Response:")) or "rate-limited" in reply or "error" in reply.lower()

    def generate(self, prompt: str) -> str:
        reply = self.first.generate(prompt)
        return self.second.generate(prompt) if self.failed(reply) else reply

    def generate_batch(self, prompts: list[str]) -> list[str]:
        out: list[str] = []
        for p in prompts:
            reply = self.first.generate(p)
            if self.failed(reply):
                return out + self.second.generate_batch(prompts[len(out) :])
            out.append(reply)
        return out

    def embeddings(self, texts: list[str]) -> list[list[float]]:
        got = self.first.embeddings(texts)
        return got if all(any(v) for v in got) else self.second.embeddings(texts)


def replies(rows: DataFrame, make: Callable[[], Provider], prompt: Column, out: str = "reply") -> DataFrame:
    """The rows with the provider's reply to a prompt; ``make`` builds the provider once a task. A null prompt has a null reply."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            prompts = b.column(b.num_columns - 1).to_pylist()
            asked = iter(provider.generate_batch([p for p in prompts if p is not None]))
            answers = [None if p is None else next(asked) for p in prompts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(answers, pa.string())], [*kept, out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    return rows.select(*(F.col(f"`{c}`") for c in kept), prompt.alias("_prompt")).mapInArrow(run, schema)


def embedded(rows: DataFrame, make: Callable[[], Provider], text: str = "text", out: str = "embedding") -> DataFrame:
    """The rows with the provider's vector of a text; a null text counts as empty."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            vectors = provider.embeddings([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], [*kept, out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("_text")).mapInArrow(run, schema)


CONCEPT = "struct<name:string,type:string,description:string,related:array<string>>"
RELATION = "struct<source:string,target:string,type:string,strength:double>"


def extracted_concepts(docs: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """doc_id, name, type, description, related_concepts, chunks: what the provider finds in each chunk, merged by name."""
    chunks = C.extraction_chunks(docs).select("doc_id", F.col("chunk_index").alias("chunk"), "text")
    asked = replies(chunks, make, F.concat(F.lit("List the concepts of this text as a JSON array of objects with name, type, description and related.\n\n"), "text"))
    found = asked.select("doc_id", "chunk", F.explode(X.json_in_text(F.col("reply"), CONCEPT)).alias("c")).select("doc_id", "chunk", "c.*").where("name is not null")
    return K.merge_chunks(found.withColumn("related", F.coalesce("related", F.array().cast("array<string>"))))


def extracted_relations(docs: DataFrame, concepts: DataFrame, make: Callable[[], Provider], names: int = 25) -> DataFrame:
    """doc_id, source, target, type, strength: what the provider says of the first ``names`` concepts of each text."""
    first = concepts.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("name")), 1, names).alias("names"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(first, "doc_id")
    asked = replies(rows.select("doc_id", F.array_join("names", ", ").alias("names"), "text"), make, F.concat(F.lit("List the relations of these concepts in the text as a JSON array of objects with source, target, type and strength.\n"), "names", F.lit("\n\n"), "text"))
    found = asked.select("doc_id", F.explode(X.json_in_text(F.col("reply"), RELATION)).alias("r")).select("doc_id", "r.*")
    return found.select("doc_id", "source", "target", X.relation_type(F.col("type")).alias("type"), "strength")


def summaries(docs: DataFrame, make: Callable[[], Provider], size: int = 4000) -> DataFrame:
    """doc_id, summary of the first ``size`` characters, as much as the model is given."""
    return replies(docs.select("doc_id", F.left("text", F.lit(size)).alias("text")), make, F.concat(F.lit("Summarise this text.\n\n"), "text"), "summary").select("doc_id", "summary")


def sentiments(docs: DataFrame, make: Callable[[], Provider], size: int = 1000) -> DataFrame:
    """doc_id, sentiment: POSITIVE, NEGATIVE, NEUTRAL, MIXED or UNKNOWN."""
    asked = replies(docs.select("doc_id", F.left("text", F.lit(size)).alias("text")), make, F.concat(F.lit("Is this text positive, negative, neutral or mixed?\n\n"), "text"))
    return asked.select("doc_id", X.sentiment_label(F.col("reply")).alias("sentiment"))


def sql_of(provider: Provider, question: str, tables: dict[str, DataFrame]) -> str:
    """The provider's SQL for a question over the tables; the text between the first SELECT or WITH and a semicolon."""
    about = "; ".join(f"{name}({', '.join(df.columns)})" for name, df in tables.items())
    reply = provider.generate(f"Tables: {about}. Give one SQL query that answers: {question}")
    found = re.search(r"(?is)\b(?:select|with)\b[^;]*", reply)
    if not found:
        raise ValueError("the reply holds no query")
    return found[0].strip()
