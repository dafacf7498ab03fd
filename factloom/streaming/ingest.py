"""Incremental ingestion as a stream: new files of a folder update a table of file hashes batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.incremental import changed_files


def latest(history: DataFrame) -> DataFrame:
    """path and hash as last seen; history has path, hash, version."""
    return history.groupBy("path").agg(F.max_by("hash", "version").alias("hash"))


def follow(spark: SparkSession, incoming: str, history: str, checkpoint: str, schema: str = "path string, text string") -> StreamingQuery:
    """Reads all JSON files in a folder that are new since the checkpoint, and appends files whose hash changed to history.

    A batch is written under its number, so a batch that is repeated after a
    failure replaces its own rows.
    """

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).groupBy("path").agg(F.max("hash").alias("hash"))
        try:
            known = latest(spark.read.parquet(history).filter(F.col("version") < number))
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            known = spark.createDataFrame([], "path string, hash string")
        changed_files(known, rows).write.mode("overwrite").parquet(f"{history}/version={number}")

    stream = spark.readStream.schema(schema).json(incoming)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
