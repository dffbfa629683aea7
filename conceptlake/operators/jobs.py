"""Jobs as an append-only log: jobs(job_id, job_type, status, created_by, seq, total_items, processed_items, created_at, ...)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "job_id string, job_type string, status string, created_by string, seq long, total_items long, processed_items long, created_at timestamp, started_at timestamp, completed_at timestamp, result string, error string"
TERMINAL = ("completed", "failed", "cancelled")


def latest(log: DataFrame) -> DataFrame:
    """The last row of each job."""
    rest = [c for c in log.columns if c not in ("job_id", "seq")]
    return log.groupBy("job_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("job_id", "r.*")


def filtered(jobs: DataFrame, status: list[str] | str | None = None, job_type: str | None = None, created_by: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("job_type", job_type), ("created_by", created_by)):
        if value is not None:
            jobs = jobs.where(F.col(column).isin(value if isinstance(value, list) else [value]))
    return jobs


def progress(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("progress", F.when(F.col("total_items") > 0, F.col("processed_items") / F.col("total_items") * 100).otherwise(0.0))


def cancellations(jobs: DataFrame, job_ids: list[str], client: str | None = None) -> DataFrame:
    """Rows to append: only queued or running jobs, only the client's own if one is named."""
    rows = jobs.where(F.col("job_id").isin(job_ids)).where(F.col("status").isin("queued", "running"))
    return (rows.where(F.col("created_by") == client) if client else rows).withColumn("status", F.lit("cancelled"))


def without_old(jobs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    old = F.col("status").isin(*TERMINAL) & (F.to_timestamp(F.lit(now)) - F.col("completed_at") > F.expr(f"interval {hours} hours"))
    return jobs.where(~F.coalesce(old, F.lit(False)))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def listed(jobs: DataFrame, n: int = 10) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(n).select("job_id", "status", F.coalesce("error", "result").alias("message"))


class Runner:
    """Runs jobs on threads of the driver, each as a Spark job group of its own, and keeps their log as a table.

    Each change of a job is a row, written to a folder of its own under ``path``, since jobs write at the same time; the
    last row of a job counts.
    """

    def __init__(self, spark: SparkSession, path: str, threads: int = 4):
        self.spark, self.path = spark, path
        self.pool = ThreadPoolExecutor(threads)
        self.running: dict[str, Future] = {}

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(self.path)

    def _append(self, job: dict, **change) -> dict:
        job = job | change | {"seq": job["seq"] + 1}
        row = self.spark.createDataFrame([(job["job_id"], job["job_type"], job["status"], job["created_by"], job["seq"], job["total_items"], job["processed_items"], job["result"], job["error"], job["at"])], "job_id string, job_type string, status string, created_by string, seq long, total_items long, processed_items long, result string, error string, at string")
        now = F.current_timestamp()
        times = {"created_at": F.when(F.col("at") == "created", now), "started_at": F.when(F.col("at") == "started", now), "completed_at": F.when(F.col("at") == "completed", now)}
        row.withColumns(times).select(*(c.split()[0] for c in LOG.split(", "))).coalesce(1).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        return job

    def create(self, job_type: str, work: Callable[[SparkSession], object], created_by: str | None = None, total_items: int = 0) -> str:
        """Queues ``work``; its result (as text) or its error ends the job."""
        job = {"job_id": uuid.uuid4().hex, "job_type": job_type, "status": "queued", "created_by": created_by, "seq": -1, "total_items": total_items, "processed_items": 0, "result": None, "error": None, "at": "created"}
        job = self._append(job)
        self.running[job["job_id"]] = self.pool.submit(self._run, job, work)
        return job["job_id"]

    def _run(self, job: dict, work: Callable[[SparkSession], object]) -> None:
        self.spark.sparkContext.setJobGroup(job["job_id"], job["job_type"], interruptOnCancel=True)
        job = self._append(job, status="running", at="started")
        try:
            result = work(self.spark)
        except Exception as error:  # what a job fails of is its result
            self._append(job, status="failed", error=str(error)[:2000], at="completed")
        else:
            self._append(job, status="completed", result=None if result is None else str(result), processed_items=job["total_items"], at="completed")

    def cancel(self, job_id: str, client: str | None = None) -> bool:
        """Ends a queued or running job, only the client's own if one is named; whether there was one."""
        rows = cancellations(latest(self.log()), [job_id], client).collect()
        if not rows:
            return False
        if not self.running[job_id].cancel():
            self.spark.sparkContext.cancelJobGroup(job_id)
        r = rows[0]
        # above every number that the running thread may still write
        self._append({"job_id": r.job_id, "job_type": r.job_type, "created_by": r.created_by, "seq": 1 << 32, "total_items": r.total_items, "processed_items": r.processed_items, "result": None, "error": None}, status="cancelled", at="completed")
        return True

    def wait(self, job_id: str) -> str:
        """The job's status after its end."""
        future = self.running[job_id]
        if not future.cancelled():
            future.exception()
        return latest(self.log()).where(F.col("job_id") == job_id).first().status
