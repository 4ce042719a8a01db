"""Continuous queries over folders that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..catalog import TableConfig


def follow(spark: SparkSession, config: TableConfig, schema: StructType | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a folder, old and new, as a stream of rows. A schema or declared columns are needed."""
    schema = schema or config.schema()
    if schema is None:
        raise ValueError("a stream needs a schema")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if config.format in ("csv", "tsv"):
        return reader.options(header=config.has_header, sep=config.delimiter, quote=config.quote, escape=config.escape or config.quote).csv(config.file_path)
    if config.format == "jsonl":
        return reader.json(config.file_path)
    if config.format == "parquet":
        return reader.parquet(config.file_path)
    raise ValueError(f"{config.format} files cannot be followed")


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per key and tumbling window of event time; rows later than ``late`` are dropped, and state with them."""
    window = F.window(time, width)
    return (
        stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(window.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
    )
