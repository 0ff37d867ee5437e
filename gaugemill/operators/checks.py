"""An independent answer in doubles, and differences between answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.functions.fixedpoint import mean_tenths, round1


def float_stats(values: DataFrame) -> DataFrame:
    """station, mn, mean, mx (doubles rounded to one decimal) and c of values(station, v); shares no arithmetic with station_stats."""
    grouped = values.groupBy("station").agg(F.min("v").alias("mn"), (F.sum("v") / F.count("v")).alias("mean"), F.max("v").alias("mx"), F.count("v").alias("c"))
    return grouped.select("station", *(round1(F.col(c)).alias(c) for c in ("mn", "mean", "mx")), "c")


def divergence(measurements: DataFrame) -> DataFrame:
    """Stations whose mean in doubles is rounded differently from the exact one."""
    v = F.col("tenths") / F.lit(10.0)
    both = measurements.groupBy("station").agg(mean_tenths(F.sum("tenths"), F.count("*")).alias("exact"), F.floor(round1(F.sum(v) / F.count("*")) * 10 + F.lit(0.5)).cast("long").alias("float"))
    return both.where("exact <> float")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, as often as it has them more, with side (left or right).

    Each side is read once: the rows of both are counted together, those of the right side as less than nothing.
    """
    counted = lambda df, n: df.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row"), F.lit(n).alias("n"))
    more = counted(left, 1).unionAll(counted(right, -1)).groupBy("row").agg(F.sum("n").alias("n")).where("n <> 0")
    each = more.select("row", F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("n"))))
    return each.select("row.*", "side")
