"""The canonical report {name=min/mean/max, ...}, ordered by the names' bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.functions.fixedpoint import format_tenths


def report_lines(stats: DataFrame) -> DataFrame:
    """station and line (name=min/mean/max)."""
    part = lambda c: format_tenths(F.col(c))
    return stats.select("station", F.concat("station", F.lit("="), part("mn"), F.lit("/"), part("mean"), F.lit("/"), part("mx")).alias("line"))


def report(stats: DataFrame) -> DataFrame:
    """One row, one string. Its size is that of the keys: use write_report() if they don't fit in a task."""
    return joined(report_lines(stats))


def float_report_lines(stats: DataFrame) -> DataFrame:
    """station and line out of the rounded doubles of checks.float_stats()."""
    part = lambda c: format_tenths(F.rint(F.col(c) * 10).cast("long"))
    return stats.select("station", F.concat("station", F.lit("="), part("mn"), F.lit("/"), part("mean"), F.lit("/"), part("mx")).alias("line"))


def joined(lines: DataFrame) -> DataFrame:
    """The report out of station and line."""
    all_ = F.expr("listagg(line, ', ') WITHIN GROUP (ORDER BY station)")
    return lines.agg(F.concat(F.lit("{"), F.coalesce(all_, F.lit("")), F.lit("}")).alias("report"))


def float_report(stats: DataFrame) -> DataFrame:
    """The report of the answer in doubles, printed to one decimal."""
    return joined(float_report_lines(stats))


def write_report(stats: DataFrame, path: str) -> None:
    """Lines in the order of the names, over as many files as the sort has partitions."""
    report_lines(stats).orderBy("station").select("line").write.option("lineSep", "\n").text(path)


def split_report(reports: DataFrame) -> DataFrame:
    """The entries of column report again; names may hold ', ', so only those after a digit divide."""
    inner = F.expr("substring(report, 2, length(report) - 2)")
    return reports.select(F.explode(F.split(inner, "(?<=[0-9]), ")).alias("line")).where("line <> ''")
