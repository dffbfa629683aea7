"""The way of documents into the tables: chunks, entities, links and relations of a batch as the tables' next state.

Tables: nodes(id, label, name, normalized_name, type, description, source), edges(src, dst, type, strength, description,
method), chunks(chunk_id, doc_id, ...). Every function returns whole tables; ``sinks.write_table`` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptlake.functions import chunks as C
from conceptlake.operators import dedup, entities
from conceptlake.sources import sinks

EDGE = "src string, dst string, type string, strength double, description string, method string"


def _edges(src: Column, dst: Column, kind: str) -> list[Column]:
    none = F.lit(None)
    return [src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(kind).alias("type"), none.cast("double").alias("strength"), none.cast("string").alias("description"), none.cast("string").alias("method")]


def link_chunks(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a Chunk node for each chunk (its text as the description) and HAS_CHUNK from its document."""
    made = chunks.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("label"), F.col("text").alias("description"))
    links = chunks.select(*_edges(F.col("doc_id"), F.col("chunk_id"), "HAS_CHUNK"))
    return upsert_nodes(nodes, made), sinks.insert_if_absent(edges, links, ["src", "dst", "type"])


def upsert_nodes(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """Nodes with the new ones; of a repeated id the least new row counts. Values that are not null win."""
    return sinks.upsert(nodes, sinks.first_rows(made, ["id"]), ["id"])


def link_entities(nodes: DataFrame, edges: DataFrame, found: DataFrame, targets: list[str], kind: str = "MENTIONS") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the entities (concept_id, name, source, and label and description if there) and a link from each of the target columns.

    A label that is no plain name becomes Concept. Links need both of their nodes; those that exist stay as they are.
    """
    label = sinks.safe_label(F.col("label")) if "label" in found.columns else F.lit("Concept")
    text = F.col("description") if "description" in found.columns else F.lit(None).cast("string")
    made = found.select(F.col("concept_id").alias("id"), label.alias("label"), "name", F.lower(F.trim("name")).alias("normalized_name"), label.alias("type"), text.alias("description"), "source")
    nodes = upsert_nodes(nodes, made)
    for column in targets:
        links = found.select(*_edges(F.col(column), F.col("concept_id"), kind))
        edges = add_links(nodes, edges, links)
    return nodes, edges


def add_links(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with the links both of whose nodes exist and that aren't there yet; of repeated ones the least in the order of their properties counts."""
    ids = nodes.select("id").distinct()
    known = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return sinks.insert_if_absent(edges, known, ["src", "dst", "type"])


def link_concepts(nodes: DataFrame, edges: DataFrame, links: DataFrame, strength: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with RELATED_TO for each of links(source, target, strength), whose ends are ids (``concept-`` first) or names.

    An id must exist. A name beside an id is sought in any case and must exist. Where both are names, they are matched as
    they are written, and missing ones become nodes. A link that exists stays as it is.
    """
    named = (~F.col("source").startswith("concept-")) & (~F.col("target").startswith("concept-"))
    both, mixed = links.where(named), links.where(~named)
    mixed = sinks.resolve_endpoint(F.col("source"), nodes, mixed, "src")
    mixed = sinks.resolve_endpoint(F.col("target"), nodes, mixed, "dst").select("src", "dst", "strength")
    names = both.select(F.col("source").alias("name")).union(both.select("target")).distinct()
    missing = names.join(nodes.where("label = 'Concept'").select("name").distinct(), "name", "left_anti")
    made = missing.select(F.concat(F.lit("concept-"), F.left(F.sha2("name", 256), F.lit(16))).alias("id"), F.lit("Concept").alias("label"), "name", F.lower(F.trim("name")).alias("normalized_name"))
    nodes = upsert_nodes(nodes, made)
    ids = nodes.where("label = 'Concept'").groupBy("name").agg(F.min("id").alias("id"))
    exact = both.join(ids.withColumnsRenamed({"name": "source", "id": "src"}), "source").join(ids.withColumnsRenamed({"name": "target", "id": "dst"}), "target").select("src", "dst", "strength")
    rows = mixed.union(exact).where("src is not null and dst is not null").select("src", "dst", F.lit("RELATED_TO").alias("type"), F.coalesce("strength", F.lit(strength)).alias("strength"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("method"))
    return nodes, add_links(nodes, edges, rows)


def legacy_vectors(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """id, document, concept_ids (comma list in the order of the text), concept_id (the first) of each document."""
    of = mentions.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "concept_id"))), lambda x: x["concept_id"]).alias("ids"))
    ids = F.array_distinct("ids")
    return docs.join(of, "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.array_join(ids, ",").alias("concept_ids"), F.get(ids, F.lit(0)).alias("concept_id"))


def add_documents(docs: DataFrame, store: DataFrame, nodes: DataFrame, edges: DataFrame, domain: str | None = None) -> dict[str, DataFrame]:
    """The whole way of a batch (doc_id string, title, text): duplicates of the batch or the store go; the others' chunks, entities and relations.

    Returns documents (added), chunks, mentions, nodes, edges.
    """
    added = dedup.new_documents(docs, store)
    chunks = C.document_chunks(added.drop("hash"))
    found = entities.lexicon_entities(added, entities.lexicon(domain))
    named = found.select("doc_id", F.col("keyword").alias("name"), "source")
    relations = entities.fuse_relations(entities.pattern_relations(added, named), entities.cooccurrence(named))
    known = found.select("doc_id", F.col("keyword").alias("name"), "concept_id")
    related = entities.map_relations(relations.withColumnsRenamed({"src": "source", "dst": "target"}), known).select("src", "dst", "type", "strength", F.lit(None).cast("string").alias("description"), "method")
    own = added.select(F.col("doc_id").cast("string").alias("id"), F.lit("Document").alias("label"), F.col("title").alias("name"))
    nodes = upsert_nodes(nodes, own)
    nodes, edges = link_chunks(nodes, edges, chunks)
    nodes, edges = link_entities(nodes, edges, found.withColumn("doc_id", F.col("doc_id").cast("string")), ["doc_id"])
    strongest = related.groupBy("src", "dst", "type").agg(F.max("strength").alias("strength"), F.min("description").alias("description"), F.max("method").alias("method"))
    return {"documents": added, "chunks": chunks, "mentions": found, "nodes": nodes, "edges": sinks.merge_relations(edges, strongest)}
