"""One method for each request that a service would offer; all but the jobs return lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptlake.operators import dedup, graph, ingest, jobs, vector
from conceptlake.plugins import Provider, sql_of
from conceptlake.sources import readers


class Lake:
    def __init__(self, spark: SparkSession, runner: jobs.Runner | None = None, **tables: DataFrame):
        """tables: nodes, edges, mentions, chunks, vectors, documents, as far as they exist."""
        self.spark, self.t, self.runner = spark, tables, runner
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        if name not in self.t:
            raise LookupError(f"there is no table {name}")
        return self.t[name]

    def ping(self) -> dict[str, object]:
        return {"status": "ok", "version": self.spark.version, "tables": sorted(self.t)}

    def health(self, dims: int) -> DataFrame:
        return vector.health(self.table("vectors"), dims)

    def counts(self) -> DataFrame:
        return graph.counts(self.table("nodes"), self.table("edges"))

    def search(self, query: list[float], n: int = 5, hops: int = 2) -> dict[str, DataFrame]:
        if not query or n < 1 or hops < 1:
            raise ValueError("a search needs a vector, a number of results and of hops")
        return {"vector_results": vector.knn(self.table("vectors"), query, n), "graph_results": vector.hybrid(self.table("vectors"), query, self.table("edges"), n, hops)}

    def concept(self, part: str) -> DataFrame:
        """The concept with its neighbours."""
        return graph.concept(self.table("nodes"), self.table("edges"), part)

    def concepts(self) -> DataFrame:
        return self.table("nodes").where("label = 'Concept'")

    def books(self) -> DataFrame:
        return self.table("nodes").where("label = 'Book'")

    def book(self, part: str) -> DataFrame:
        """id of the concepts of the first book whose title has ``part`` as it is written."""
        found = graph.search(self.books(), part, 1, case_sensitive=True)
        return self.table("mentions").join(F.broadcast(found.select(F.col("id").alias("src"))), "src").select(F.col("dst").alias("id")).distinct()  # one row

    def related_concepts(self, node, hops: int = 2) -> DataFrame:
        return graph.reach(self.table("edges"), self.spark.createDataFrame([(node,)], ["id"]), hops).orderBy("distance", F.desc("relevance"), "target")

    def documents_by_concept(self, node) -> DataFrame:
        return graph.documents_of(self.table("mentions"), node)

    def passages_about(self, concept: str, n: int = 10) -> DataFrame:
        return graph.passages_about(self.table("chunks"), concept, n)

    def add_documents(self, docs: DataFrame, domain: str | None = None) -> dict[str, DataFrame]:
        """The tables' next state with the documents that are new."""
        store = self.table("documents").select(dedup.X.compact_hash(F.col("text")).alias("hash"))
        return ingest.add_documents(docs, store, self.table("nodes"), self.table("edges"), domain)

    def add_folder(self, path: str, endings: tuple[str, ...] = (".txt", ".md"), domain: str | None = None) -> dict[str, DataFrame]:
        """As add_documents, of a folder's files; a document's id is the hash of its path."""
        files = readers.folder(self.spark, path, endings).withColumn("doc_id", F.concat(F.lit("doc-"), F.left(F.sha2("file_path", 256), F.lit(16))))
        return self.add_documents(files, domain)

    def _runner(self) -> jobs.Runner:
        if self.runner is None:
            raise LookupError("there is no job runner")
        return self.runner

    def start(self, job_type: str, work: Callable[[SparkSession], object], client: str | None = None) -> str:
        return self._runner().create(job_type, work, client)

    def cancel(self, job_id: str, client: str | None = None) -> bool:
        return self._runner().cancel(job_id, client)

    def list_jobs(self, **by) -> DataFrame:
        return jobs.listed(jobs.filtered(jobs.latest(self._runner().log()), **by))

    def job_status(self, job_id: str) -> DataFrame:
        return jobs.progress(jobs.latest(self._runner().log()).where(F.col("job_id") == job_id))

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def ask(self, provider: Provider, question: str) -> DataFrame:
        """The answer to a question by the provider's SQL."""
        return self.spark.sql(sql_of(provider, question, self.t))
