"""Fact tables on disk: append, read, and key-value metadata of which the last write counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def put_metadata(spark: SparkSession, path: str, key: str, value: str) -> None:
    spark.createDataFrame([(key, value)], "key string, value string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def get_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key and the value written last."""
    rows = spark.read.parquet(path)
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("value")))
    return rows.withColumn("nth", nth).filter("nth = 1").select("key", "value")


def as_json(rows: DataFrame, command: str, total: int | None = None) -> DataFrame:
    """One JSON document per row, in an envelope that names the command."""
    fields = [F.lit(command).alias("command"), F.struct(*rows.columns).alias("result")]
    if total is not None:
        fields.append(F.lit(total).alias("total_count"))
    return rows.select(F.to_json(F.struct(*fields)).alias("json"))
