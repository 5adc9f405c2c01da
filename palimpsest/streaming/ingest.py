"""Incremental ingest: digests of newly arrived shards, appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.exact import scan

SCHEMA = "doc_id long, text string"


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scan new files of a folder and append their digests as one folder a batch.

    Spark's checkpoint remembers the files seen. A batch that is run again
    after a failure overwrites its own folder, so each row is there once.
    """

    def append(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def unseen(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a scan whose digest no earlier batch has."""
    return new.join(known.select("sha256").distinct(), "sha256", "left_anti").withColumn("first_seen", F.current_timestamp())
