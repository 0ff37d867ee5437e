"""Minimum, maximum, sum and count by key as a state that merges in any order, and the mean derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugemill.functions.fixedpoint import mean_tenths, whole_div

STATE = ["mn", "mx", "s", "c"]


def state_of(value: Column) -> list[Column]:
    return [F.min(value).alias("mn"), F.max(value).alias("mx"), F.sum(value).alias("s"), F.count(value).alias("c")]


def partial_stats(measurements: DataFrame, *by: str | Column) -> DataFrame:
    """The state for each station and each of the further keys."""
    return measurements.groupBy("station", *by).agg(*state_of(F.col("tenths")))


def merge_stats(*states: DataFrame) -> DataFrame:
    """One state for each station out of any number of states."""
    all_ = states[0]
    for other in states[1:]:
        all_ = all_.unionByName(other, allowMissingColumns=True)
    return all_.groupBy("station").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("s").alias("s"), F.sum("c").alias("c"))


def with_mean(states: DataFrame) -> DataFrame:
    return states.withColumn("mean", mean_tenths(F.col("s"), F.col("c")))


def station_stats(measurements: DataFrame) -> DataFrame:
    """station, mn, mean, mx, s, c in tenths: partial and final hash aggregation around one exchange, for the caller to order."""
    return with_mean(partial_stats(measurements)).select("station", "mn", "mean", "mx", "s", "c")


def checksum(measurements: DataFrame) -> DataFrame:
    """x (exclusive or of all values, in any order), n rows, k stations."""
    return measurements.agg(F.bit_xor("tenths").alias("x"), F.count("*").alias("n"), F.countDistinct("station").alias("k"))


def timing_summary(runs: DataFrame, label: str, seconds: str) -> DataFrame:
    """Median, least, most and number of timings by label, exactly.

    Equal timings of a label are counted first, in partial aggregations; a running count over its different ones finds the middle.
    For labels with too many different timings for a task there is timing_summary_approx().
    """
    counts = runs.groupBy(F.col(label).alias("label"), F.col(seconds).alias("v")).agg(F.count(seconds).alias("times"))
    label_, so_far = Window.partitionBy("label"), Window.partitionBy("label").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("times").over(so_far), "n": F.sum("times").over(label_)})
    at = lambda rank: F.max(F.when((rank >= F.col("upto") - F.col("times")) & (rank < F.col("upto")), F.col("v")))
    middle = 0.5 * at(whole_div(F.col("n") - 1, F.lit(2))) + 0.5 * at(whole_div(F.col("n"), F.lit(2)))
    return placed.groupBy("label").agg(middle.alias("median"), F.min("v").alias("least"), F.max("v").alias("most"), F.max("n").alias("n"))


def timing_summary_approx(runs: DataFrame, label: str, seconds: str, accuracy: int = 10_000) -> DataFrame:
    """As timing_summary(), with a median whose rank is off by at most n / accuracy; its state is a sketch, whatever the label has."""
    return runs.groupBy(F.col(label).alias("label")).agg(F.percentile_approx(seconds, 0.5, accuracy).alias("median"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.count(seconds).alias("n"))


def worker_phases(spent: DataFrame) -> DataFrame:
    """Over spent(worker, read, total), integers: mean read and total in whole units, read's share in tenths of a percent, spread of total."""
    per = spent.groupBy("worker").agg(F.sum("read").alias("read"), F.sum("total").alias("total"))
    mean = lambda c: mean_tenths(F.sum(c), F.count("*"))
    return per.agg(F.count("*").alias("workers"), mean("read").alias("mean_read"), mean("total").alias("mean_total"), mean_tenths(F.sum("read") * 1000, F.sum("total")).alias("read_share"), (F.max("total") - F.min("total")).alias("spread"))
