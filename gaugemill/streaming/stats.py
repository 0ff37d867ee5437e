"""The group statistics over a stream: the state is the same mergeable one, kept by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gaugemill.operators.stats import station_stats
from gaugemill.sources.measurements import clean_lines, from_table, parse
from gaugemill.sources.scratch import scratch_path


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet files of one table as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a folder's text files as a stream, cleaned as read_lines() does."""
    return clean_lines(spark.readStream.option("lineSep", "\n").text(folder))


def streaming_stats(lines_or_rows: DataFrame, key: str | None = None, value: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Statistics of a stream of lines, or of rows with a key and a value."""
    return station_stats(from_table(lines_or_rows, key, value) if key else parse(lines_or_rows, mode))


def drained(stream: DataFrame) -> DataFrame:
    """Run a complete-mode stream over what is there now and give the final state."""
    spark = stream.sparkSession
    name = f"stats_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
