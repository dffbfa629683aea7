"""Property graph on two tables: nodes(id, label, name, ...), edges(edge_id, src, dst, type, strength)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conceptlake.functions import text as X
from conceptlake.tables import cut, shared_path


def undirected(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    rows = edges.where(F.col("type").isin(types)) if types else edges
    return rows.select("edge_id", "src", "dst", "strength").union(rows.select("edge_id", F.col("dst"), F.col("src"), "strength"))


#: Edges of a node from which on they lie in several buckets, edges of a bucket, and hubs that are sent to every task.
HUB, IN_BUCKET, SENT_HUBS = 100_000, 2_000_000, 100_000
#: Nodes whose edges are looked up by their buckets; more are joined.
LOOKED_UP = 2000


class Adjacency:
    """Edges in both directions, written once as a table that is bucketed and sorted by the node they start from.

    ``place`` is a hash of the node and, for hubs, of one of several salts, so that a hub's edges lie in several buckets.
    Few nodes read their buckets alone; many are shuffled to the buckets, and the edges stay where they are. The table
    lies in the folder that all executors share.
    """

    def __init__(self, edges: DataFrame, types: list[str] | None = None, hub: int = HUB):
        self.spark = edges.sparkSession
        sym = undirected(edges, types).where("src is not null and dst is not null")
        degrees = sym.groupBy("src").agg(F.count("*").alias("n")).cache()
        total = degrees.agg(F.sum("n")).first()[0] or 0
        self.hubs = cut(degrees.where(F.col("n") > hub).select(F.col("src").alias("hub"), F.ceil(F.col("n") / hub).cast("int").alias("salts")))
        degrees.unpersist()
        self.few_hubs = self.hubs.count()
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // IN_BUCKET))
        salted = self._with_hubs(sym, "src").withColumn("place", self._place("src", F.pmod(F.xxhash64("dst"), F.col("salts")))).drop("salts")
        self.name = f"adjacency_{uuid.uuid4().hex}"
        salted.repartition(buckets, "place").write.bucketBy(buckets, "place").sortBy("place").option("path", f"{shared_path(self.spark)}/{self.name}").saveAsTable(self.name)

    @staticmethod
    def _place(node: str, salt: Column) -> Column:
        return F.xxhash64(F.col(node).cast("string"), salt.cast("long"))

    def _with_hubs(self, rows: DataFrame, node: str) -> DataFrame:
        if not self.few_hubs:
            return rows.withColumn("salts", F.lit(1))
        hubs = F.broadcast(self.hubs) if self.few_hubs <= SENT_HUBS else self.hubs
        return rows.join(hubs, F.col(node) == F.col("hub"), "left").withColumn("salts", F.coalesce("salts", F.lit(1))).drop("hub")

    def step(self, rows: DataFrame, node: str = "at") -> DataFrame:
        """The rows with each edge (edge_id, src, dst, strength) that leaves their node."""
        placed = self._with_hubs(rows, node).withColumn("_place", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        placed = placed.withColumn("_place", self._place(node, F.col("_place"))).drop("salts")
        found = [r[0] for r in placed.select("_place").distinct().limit(LOOKED_UP + 1).collect()]
        table = self.spark.table(self.name)
        if len(found) <= LOOKED_UP:
            table = table.where(F.col("place").isin(found))
        return placed.join(table, (F.col("_place") == F.col("place")) & (F.col(node) == F.col("src"))).drop("_place", "place")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def neighbours(edges: DataFrame | Adjacency, node, types: list[str] | None = None) -> DataFrame:
    """id, strength of the nodes one hop away; the strongest edge counts, and one without a strength is stronger than all (null)."""
    sym = edges.step(edges.spark.createDataFrame([(node,)], ["at"])) if isinstance(edges, Adjacency) else undirected(edges, types).where(F.col("src") == node)
    near = sym.groupBy(F.col("dst").alias("id"))
    return near.agg(F.when(F.count_if(F.col("strength").isNull()) == 0, F.max("strength")).alias("strength"))


def documents_of(mentions: DataFrame, concept) -> DataFrame:
    return mentions.where(F.col("dst") == concept).select(F.col("src").alias("id")).distinct()


def concepts_of(mentions: DataFrame, document) -> DataFrame:
    return mentions.where(F.col("src") == document).select(F.col("dst").alias("id")).distinct()


def shared_concepts(mentions: DataFrame, top: int = 10) -> DataFrame:
    """concept, n: documents with a larger partner for the same concept (all but its last), most first."""
    per = mentions.select("src", "dst").distinct().groupBy("dst").agg((F.count("*") - 1).alias("n"))
    return per.where("n > 0").select(F.col("dst").alias("concept"), "n").orderBy(F.desc("n"), "concept").limit(top)


def _step(edges: DataFrame | Adjacency, now: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The paths ``now`` with each edge that leaves their end and that they haven't used."""
    if isinstance(edges, Adjacency):
        return edges.step(now).where(~F.array_contains("used", F.col("edge_id")))
    return now.join(undirected(edges, types), (F.col("at") == F.col("src")) & ~F.array_contains("used", F.col("edge_id")))


def _walk(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int, types: list[str] | None = None) -> list[DataFrame]:
    """(start, at, used, total) by number of hops: paths that use no edge twice, ``used`` being the edges that a longer path must avoid.

    Of one hop's paths that end alike (in start, node and used edges) only the best sum goes on. Two hops know their last
    edge alone, so the paths that go on are as many as (start, edge) pairs and not as the paths.
    """
    now = seeds.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast("array<bigint>").alias("used"), F.lit(0.0).alias("total")).distinct()
    levels = []
    for h in range(1, hops + 1):
        now = _step(edges, now, types).withColumn("strength", F.coalesce("strength", F.lit(0.5)))
        used = F.array_sort(F.array_append("used", F.col("edge_id"))) if h < hops else F.array().cast("array<bigint>")
        now = now.select("start", F.col("dst").alias("at"), used.alias("used"), (F.col("total") + F.col("strength")).alias("total"))
        now = now.groupBy("start", "at", "used").agg(F.max("total").alias("total"))
        levels.append(now.withColumn("hops", F.lit(h)))
    return levels


def reach(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int = 2, types: list[str] | None = None, exclude_start: bool = False) -> DataFrame:
    """target, relevance (largest path sum of strengths), hops, distance (hops - 1), over paths that use no edge twice."""
    rows = reduce(DataFrame.unionByName, _walk(edges, seeds, hops, types))
    if exclude_start:
        rows = rows.where("at <> start")
    return rows.groupBy(F.col("at").alias("target")).agg(F.max("total").alias("relevance"), F.min("hops").alias("hops")).withColumn("distance", F.col("hops") - 1)


def by_distance(reached: DataFrame) -> DataFrame:
    """distance, n, targets (strongest first): what is reached, grouped by its distance."""
    per = reached.groupBy("distance").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), F.col("target")))).alias("t"))
    return per.select("distance", "n", F.transform("t", lambda x: x["target"]).alias("targets"))


def paths(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """start, at, hops, used: a row for each path."""
    now = seeds.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast("array<bigint>").alias("used"))
    levels = []
    for h in range(1, hops + 1):
        now = _step(edges, now).select("start", F.col("dst").alias("at"), F.array_append("used", F.col("edge_id")).alias("used"))
        levels.append(now.withColumn("hops", F.lit(h)))
    return reduce(DataFrame.unionByName, levels)


def contained(edges: DataFrame, root) -> DataFrame:
    """id of all that ``root`` contains, at any depth.

    Each step joins what the last one reached anew with the edges, and leaves out what was reached before, so a node
    that many paths lead to counts once and a cycle ends. Deep chains or many roots: ``closure``.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null")
    new = cut(links.where(F.col("src") == root).select(F.col("dst").alias("id")).distinct())
    found = new
    while not new.isEmpty():
        new = cut(new.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti"))
        found = cut(found.union(new))
    return found


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, id): all that each node contains, at any depth, for all nodes or those of ``roots`` (id).

    Paths double in each round, so that a chain of n nodes takes log n rounds; cycles end, since a pair counts once.
    """
    found = cut(edges.select(F.col("src").alias("root"), F.col("dst").alias("id")).where("root is not null and id is not null").distinct())
    new = found
    while not new.isEmpty():
        # a longer path ends with a pair that the last round found, or begins with one
        longer = new.join(found.select(F.col("root").alias("id"), F.col("id").alias("to")), "id").select("root", F.col("to").alias("id"))
        before = found.join(new.select(F.col("root").alias("id"), F.col("id").alias("to")), "id").select("root", F.col("to").alias("id"))
        new = cut(longer.union(before).distinct().join(found, ["root", "id"], "left_anti"))
        found = cut(found.union(new))
    return found if roots is None else found.join(roots.select(F.col("id").alias("root")).distinct(), "root", "left_semi")


def search(nodes: DataFrame, part: str, top: int = 10, case_sensitive: bool = False) -> DataFrame:
    """id, name of the nodes whose name has ``part``; the shortest names first."""
    return nodes.where(X.contains_name(F.col("name"), part, case_sensitive)).orderBy(F.length("name"), "name", "id").limit(top).select("id", "name")


def concept(nodes: DataFrame, edges: DataFrame, part: str, types: list[str] | None = None) -> DataFrame:
    """id, name of the first node that ``part`` finds, with related_id, related, strength of each neighbour (one row with nulls if it has none), strongest first."""
    found = search(nodes, part, 1)
    sym = undirected(edges, types).join(F.broadcast(found.select(F.col("id").alias("src"))), "src")  # one row
    near = sym.groupBy("src", F.col("dst").alias("related_id")).agg(F.when(F.count_if(F.col("strength").isNull()) == 0, F.max("strength")).alias("strength"))
    named = near.join(nodes.select(F.col("id").alias("related_id"), F.col("name").alias("related")), "related_id", "left")
    out = found.join(named, F.col("id") == F.col("src"), "left").select("id", "name", "related_id", "related", "strength")
    return out.orderBy(F.desc_nulls_first("strength"), F.asc_nulls_last("related_id"))


def detail(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, related: each node with its neighbours (empty without any)."""
    near = undirected(edges).groupBy("src").agg(F.array_sort(F.collect_set(F.struct(F.col("dst").alias("id"), "strength"))).alias("related"))
    return nodes.select("id", "name").join(near, F.col("id") == F.col("src"), "left").select("id", "name", F.coalesce("related", F.array().cast(near.schema["related"].dataType)).alias("related"))


def triangle(edges: DataFrame, mentions: DataFrame, document) -> DataFrame:
    """concept, other: a document's concepts with related concepts of the same document, if any."""
    own = concepts_of(mentions, document)
    near = undirected(edges).join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    return own.join(near.distinct(), "id", "left").select(F.col("id").alias("concept"), "other")


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("src"), F.col("name").alias("source")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("target"))
    return edges.join(a, "src").join(b, "dst").select("source", "target", "type", "strength")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def strength_histogram(edges: DataFrame) -> DataFrame:
    return edges.where("strength is not null").groupBy(X.strength_bucket(F.col("strength")).alias("bucket")).agg(F.count("*").alias("n"))


def chunks_about(chunks: DataFrame, concept: str, top: int = 10, distinct: bool = True) -> DataFrame:
    """Chunks whose concept_id is the concept, then those whose comma list has it."""
    one = chunks.where(F.col("concept_id") == concept).withColumn("ord", F.lit(0))
    many = chunks.where(F.array_contains(F.split("concept_ids", ","), concept)).withColumn("ord", F.lit(1))
    rows = one.unionByName(many)
    if distinct:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_n = 1").drop("_n")
    return rows.orderBy("ord", "id").limit(top)


def passages_about(chunks: DataFrame, concept_id: str, top: int = 10, size: int = 200) -> DataFrame:
    """Chunks about the concept, with snippets of their text."""
    return chunks_about(chunks, concept_id, top).withColumn("snippet", X.snippet(F.col("text"), size))


def of_type(nodes: DataFrame, kind: str, column: str = "document_type") -> DataFrame:
    """Nodes of a document type."""
    return nodes.where(F.col(column) == kind)


def at_least(rows: DataFrame, weight: float | None = None, length: int | None = None) -> DataFrame:
    """Rows of the weight and length of text at least; a null meets neither."""
    if weight is not None:
        rows = rows.where(F.col("weight") >= weight)
    return rows if length is None else rows.where(F.length("text") >= length)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, relationships, concepts, documents in one row."""
    of = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "Concept").alias("concepts"), F.count_if(F.col("label") == "Document").alias("documents"))
    return of.join(edges.agg(F.count("*").alias("relationships"))).select("nodes", "relationships", "concepts", "documents")  # one row each


def linked_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """chunk id with the book, chapter, section and concept it names."""
    ids = chunks.select("id", F.expr("stack(4, 'Book', book_id, 'Chapter', chapter_id, 'Section', section_id, 'Concept', concept_id) as (label, node_id)")).where("node_id is not null")
    named = nodes.select("label", F.col("id").alias("node_id"), F.coalesce("name", "title", F.lit("Unnamed")).alias("name"))
    return ids.join(named, ["label", "node_id"])


def node_chunks(chunks: DataFrame, kind: str, node_id: str) -> DataFrame:
    return chunks.where(F.col(f"{kind}_id") == node_id)


def export_tables(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a graph export."""
    return {"books": nodes.where("label = 'Book'"), "concepts": nodes.where("label = 'Concept'"), "book_concept_relationships": edges.where("type = 'MENTIONS'"), "concept_relationships": edges.where("type = 'RELATED_TO'")}
