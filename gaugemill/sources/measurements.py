"""Measurement text: lines of name;value, read whole and split by file ranges; and tables as measurements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from gaugemill.functions.fixedpoint import format_tenths, parse_tenths, quantise_tenths, valid_name, whole_div
from gaugemill.sources.scratch import scratch_path

FAILFAST, DROPMALFORMED, PERMISSIVE = "FAILFAST", "DROPMALFORMED", "PERMISSIVE"


def clean_lines(lines: DataFrame) -> DataFrame:
    """value: one carriage return at its end taken off, blank lines left out; the same for files and for streams."""
    value = F.col("value")
    whole = F.when(value.endswith("\r"), F.substr(value, F.lit(1), F.char_length(value) - 1)).otherwise(value)
    return lines.where((value != "") & (value != "\r")).select(whole.alias("value"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: every line that isn't blank, one carriage return at its end taken off. Lines end only at \\n."""
    return clean_lines(spark.read.option("lineSep", "\n").text(path))


def split_line(line: Column) -> tuple[Column, Column]:
    """Name and value text around the first semicolon; without one the name is null and the value text the whole line."""
    at = F.instr(line, ";")
    return F.when(at > 0, F.substr(line, F.lit(1), at - 1)), F.substr(line, at + 1)


def classified(lines: DataFrame) -> DataFrame:
    """station, tenths and status (ok, bad_name, bad_value) of each line in column value."""
    name, value = split_line(F.col("value"))
    named = lines.select("value", name.alias("station"), parse_tenths(value).alias("tenths"))
    status = F.when(F.col("station").isNull() | ~valid_name(F.col("station")), "bad_name").when(F.col("tenths").isNull(), "bad_value").otherwise("ok")
    return named.withColumn("status", status)


def split_valid(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(station, tenths) of the good lines, and (value, status) of the others."""
    all_ = classified(lines)
    return all_.where("status = 'ok'").select("station", "tenths"), all_.where("status <> 'ok'").select("value", "status")


def parse(lines: DataFrame, mode: str = FAILFAST) -> DataFrame:
    """station, tenths; a malformed line fails the query, is left out, or (PERMISSIVE) has null tenths."""
    if mode == DROPMALFORMED:
        return split_valid(lines)[0]
    rows, ok = classified(lines), F.col("status") == "ok"
    if mode == PERMISSIVE:
        return rows.select("station", F.when(ok, F.col("tenths")).alias("tenths"))
    tenths = F.when(ok, F.col("tenths")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("int"))
    return rows.select("station", tenths.alias("tenths"))


def read_measurements(spark: SparkSession, path: str | list[str], mode: str = FAILFAST) -> DataFrame:
    return parse(read_lines(spark, path), mode)


def from_table(df: DataFrame, key: str | Column, value: str | Column) -> DataFrame:
    """station, tenths out of any key and numeric column."""
    value = F.col(value) if isinstance(value, str) else value
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.alias("station"), quantise_tenths(value).alias("tenths"))


def as_lines(measurements: DataFrame) -> DataFrame:
    return measurements.select(F.concat("station", F.lit(";"), format_tenths(F.col("tenths"))).alias("value"))


def write_measurements(measurements: DataFrame, path: str, files: int | None = None) -> None:
    """Text files in the order of the partitions; files=1 gives a single one."""
    lines = as_lines(measurements)
    (lines.coalesce(files) if files else lines).write.option("lineSep", "\n").text(path)


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so."""
    while name.lower() in (x.lower() for x in taken):
        name = f"_{name}"
    return name


def with_offsets(lines: DataFrame, order: str, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all) of lines with start and end: the bytes that a line would take if all were written in that order.

    The one shuffle deals the lines to ranges of the order, of which each task sums up its own as it reads them; the ranges, with
    sums that count from their own beginning, are stored. Then only one total for each range meets in one place.
    """
    keep = lines.columns if keep is None else keep
    by, size, part, base = (free_name(keep, x) for x in ("by", "size", "part", "base"))
    sized = lines.select(*keep, F.col(order).alias(by), (F.octet_length(line).cast("long") + 1).alias(size))
    ranged = sized.repartitionByRange(by).sortWithinPartitions(by).drop(by)
    schema = StructType([ranged.schema[c] for c in keep]).add("start", LongType()).add("end", LongType()).add(part, LongType())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(size).to_numpy()
            end = before + np.cumsum(n)
            before = int(end[-1]) if n.size else before
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(end - n), pa.array(end), pa.array(np.full(n.size, mine))], names=schema.names)

    path = scratch_path(lines.sparkSession, "offsets")
    ranged.mapInArrow(running, schema).write.parquet(path)
    placed = lines.sparkSession.read.schema(schema).parquet(path)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(part).agg(F.max("end").alias(base)).select(part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    shifted = placed.join(F.broadcast(totals), part)  # a row for each shuffle partition
    return shifted.select(*keep, *((F.col(c) + F.col(base)).alias(c) for c in ("start", "end")))


def chunk_of(start: Column, size: int) -> Column:
    """The chunk that owns a line: a line that begins exactly on a border belongs to the chunk before it."""
    return whole_div(F.greatest(start - 1, F.lit(0)), F.lit(size))


def chunk_bounds(lines: DataFrame, size: int) -> DataFrame:
    """chunk, n_rows, first_byte, end_byte for lines with start and end."""
    return lines.groupBy(chunk_of(F.col("start"), size).alias("chunk")).agg(F.count("*").alias("n_rows"), F.min("start").alias("first_byte"), F.max("end").alias("end_byte"))


def number_of_chunks(length: int, size: int) -> int:
    return -(-length // size)
