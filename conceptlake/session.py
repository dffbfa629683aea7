"""A session with the settings that the queries assume."""

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()
