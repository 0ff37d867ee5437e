"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.functions.fixedpoint import VALUE, clamp_tenths, format_tenths, length_class, name_bytes, quantise_tenths, whole_div
from gaugemill.operators import checks, report, stats
from gaugemill.sources import generator, measurements
from gaugemill.sources.scratch import scratch_path
from gaugemill.streaming.stats import drained, stream_lines, stream_table, streaming_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measured(spark: SparkSession, sf_dir: str, name: str, key: str, value: str) -> DataFrame:
    return measurements.from_table(_table(spark, sf_dir, name), key, value)


# SQL building blocks; n and d stand for a dividend and a positive divisor
def _floor_div(n: str, d: str) -> str:
    return f"(({n}) - ((({n}) % ({d})) + ({d})) % ({d})) // ({d})"


def _tenths(v: str) -> str:
    return f"CAST(floor({v} * 10 + 0.5) AS BIGINT)"


def _text(t: str) -> str:
    return f"concat(CASE WHEN {t} < 0 THEN '-' ELSE '' END, CAST(abs({t}) // 10 AS VARCHAR), '.', CAST(abs({t}) % 10 AS VARCHAR))"


_MEAN = _floor_div("2 * s + c", "2 * c")


def _states(key: str, value: str, table: str) -> str:
    return f"(SELECT {key} AS station, min(t) AS mn, max(t) AS mx, CAST(sum(t) AS BIGINT) AS s, count(*) AS c FROM (SELECT *, {_tenths(value)} AS t FROM {table}) GROUP BY 1)"


def _stats(key: str, value: str, table: str) -> str:
    return f"SELECT station, mn, {_MEAN} AS mean, mx, s, c FROM {_states(key, value, table)}"


def _lines(key: str, value: str, table: str) -> str:
    return f"SELECT station, concat(station, '=', {_text('mn')}, '/', {_text('mean')}, '/', {_text('mx')}) AS line FROM ({_stats(key, value, table)})"


@query(_stats("event_type", "value", "events"))
def station_stats(spark, sf_dir):
    return stats.station_stats(_measured(spark, sf_dir, "events", "event_type", "value"))


@query(_stats("c_mktsegment", "c_acctbal", "customer"))
def station_stats_negative(spark, sf_dir):
    return stats.station_stats(_measured(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal"))


@query(_stats("CAST(l_suppkey AS VARCHAR)", "l_extendedprice", "lineitem"))
def station_stats_many_keys(spark, sf_dir):
    return stats.station_stats(_measured(spark, sf_dir, "lineitem", F.col("l_suppkey").cast("string"), "l_extendedprice"))


@query(_stats("event_type", "value", "events") + " ORDER BY station")
def station_stats_ordered(spark, sf_dir):
    return stats.station_stats(_measured(spark, sf_dir, "events", "event_type", "value")).orderBy("station")


@query(_lines("c_mktsegment", "c_acctbal", "customer"))
def station_stats_rendered(spark, sf_dir):
    return report.report_lines(station_stats_negative(spark, sf_dir))


@query(f"SELECT concat('{{', coalesce(string_agg(line, ', ' ORDER BY station), ''), '}}') AS report FROM ({_lines('c_mktsegment', 'c_acctbal', 'customer')})")
def station_report(spark, sf_dir):
    return report.report(station_stats_negative(spark, sf_dir))


@query(f"SELECT line FROM ({_lines('c_mktsegment', 'c_acctbal', 'customer')})")
def report_entries(spark, sf_dir):
    return report.split_report(station_report(spark, sf_dir))


@query(_stats("c_mktsegment", "c_acctbal", "customer"))
def partial_final_merge(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("station"), quantise_tenths(F.col("c_acctbal")).alias("tenths"), (F.col("c_custkey") % 8).alias("worker"))
    return stats.with_mean(stats.merge_stats(stats.partial_stats(rows, "worker"))).select("station", "mn", "mean", "mx", "s", "c")


@query(_stats("station", "v", "(SELECT c_mktsegment AS station, c_acctbal AS v FROM customer UNION ALL SELECT event_type, value FROM events)"))
def two_table_merge(spark, sf_dir):
    one, two = _measured(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal"), _measured(spark, sf_dir, "events", "event_type", "value")
    return stats.with_mean(stats.merge_stats(stats.partial_stats(one), stats.partial_stats(two))).select("station", "mn", "mean", "mx", "s", "c")


_SIGNED = f"(({_tenths('value')} % 1000) * (1 - 2 * (event_id % 2)))"


def _event_lines(spark, sf_dir) -> DataFrame:
    t = (quantise_tenths(F.col("value")) % 1000) * (1 - 2 * (F.col("event_id") % 2))
    return _table(spark, sf_dir, "events").select("event_id", "event_type", t.alias("t"), F.concat("event_type", F.lit(";"), format_tenths(t)).alias("value"))


@query(f"SELECT event_id, event_type AS station, CAST({_SIGNED} AS INTEGER) AS tenths FROM events")
def parse_lines(spark, sf_dir):
    name, value = measurements.split_line(F.col("value"))
    return _event_lines(spark, sf_dir).select("event_id", name.alias("station"), measurements.parse_tenths(value).alias("tenths"))


@query(f"SELECT station, mn, {_MEAN} AS mean, mx, s, c FROM (SELECT event_type AS station, CAST(min(t) AS INTEGER) AS mn, CAST(max(t) AS INTEGER) AS mx, CAST(sum(t) AS BIGINT) AS s, count(*) AS c FROM (SELECT event_type, {_SIGNED} AS t FROM events) GROUP BY 1)")
def text_round_trip(spark, sf_dir):
    """Written as lines of text, read again by file ranges, parsed and aggregated."""
    path = scratch_path(spark, "lines")
    _event_lines(spark, sf_dir).select("value").write.option("lineSep", "\n").text(path)
    return stats.station_stats(measurements.read_measurements(spark, path))


@query(f"SELECT bit_xor({_tenths('c_acctbal')}) AS x, count(*) AS n, count(DISTINCT c_mktsegment) AS k FROM customer")
def checksum_count_distinct(spark, sf_dir):
    return stats.checksum(_measured(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal"))


@query(
    f"""WITH l AS (SELECT event_id, octet_length(encode(concat(event_type, ';', {_text(_SIGNED)}))) + 1 AS n FROM events),
    o AS (SELECT n, CAST(coalesce(sum(n) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM l)
    SELECT greatest(st - 1, 0) // 10000 AS chunk, count(*) AS n_rows, min(st) AS first_byte, CAST(max(st + n) AS BIGINT) AS end_byte FROM o GROUP BY 1"""
)
def chunk_assignment(spark, sf_dir):
    return measurements.chunk_bounds(measurements.with_offsets(_event_lines(spark, sf_dir), "event_id", keep=[]), 10_000)


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) WHERE i IN (SELECT k * 25 // 7 FROM range(7) AS r(k))")
def stride_sample(spark, sf_dir):
    return generator.stride_sample(_table(spark, sf_dir, "nation"), "n_nationkey", 7).select("n_nationkey", "n_name")


@query("SELECT CASE WHEN n < 8 THEN 'short' WHEN n < 16 THEN 'middle' ELSE 'long' END AS class, count(*) AS n_names, min(n) AS least, max(n) AS most FROM (SELECT octet_length(encode(p_name)) AS n FROM part) GROUP BY 1")
def name_length_classes(spark, sf_dir):
    n = name_bytes(F.col("p_name"))
    return _table(spark, sf_dir, "part").groupBy(length_class(F.col("p_name")).alias("class")).agg(F.count("*").alias("n_names"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("SELECT event_type AS label, median(value) AS median, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY 1")
def timing_summary(spark, sf_dir):
    return stats.timing_summary(_table(spark, sf_dir, "events"), "event_type", "value")


_SPENT = f"(SELECT event_id % 16 AS worker, sum(CASE WHEN event_id % 3 = 0 THEN {_tenths('value')} ELSE 0 END) AS r, sum({_tenths('value')}) AS t FROM events GROUP BY 1)"


@query(
    f"""SELECT n AS workers, {_floor_div('2 * r + n', '2 * n')} AS mean_read, {_floor_div('2 * t + n', '2 * n')} AS mean_total, {_floor_div('2 * r * 1000 + t', '2 * t')} AS read_share, spread
    FROM (SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS r, CAST(sum(t) AS BIGINT) AS t, CAST(max(t) - min(t) AS BIGINT) AS spread FROM {_SPENT})"""
)
def worker_phases(spark, sf_dir):
    t = quantise_tenths(F.col("value"))
    spent = _table(spark, sf_dir, "events").select((F.col("event_id") % 16).alias("worker"), F.when(F.col("event_id") % 3 == 0, t).otherwise(0).alias("read"), t.alias("total"))
    return stats.worker_phases(spent)


@query("SELECT event_type AS station, floor(min(value) * 10 + 0.5) / 10.0 AS mn, floor(sum(value) / count(*) * 10 + 0.5) / 10.0 AS mean, floor(max(value) * 10 + 0.5) / 10.0 AS mx, count(*) AS c FROM events GROUP BY 1")
def f64_oracle(spark, sf_dir):
    return checks.float_stats(_table(spark, sf_dir, "events").select(F.col("event_type").alias("station"), F.col("value").alias("v")))


@query(
    f"""SELECT station, exact, float FROM (SELECT station, {_MEAN} AS exact, CAST(floor(floor(f / c * 10 + 0.5) / 10.0 * 10 + 0.5) AS BIGINT) AS float
    FROM (SELECT c_custkey // 2 AS station, CAST(sum({_tenths('c_acctbal')}) AS BIGINT) AS s, count(*) AS c, sum({_tenths('c_acctbal')} / 10.0) AS f FROM customer GROUP BY 1)) WHERE exact <> float"""
)
def oracle_divergence(spark, sf_dir):
    """Two rows for each key, so that the order of a sum in doubles cannot matter."""
    return checks.divergence(_measured(spark, sf_dir, "customer", whole_div(F.col("c_custkey"), F.lit(2)), "c_acctbal"))


@query(f"SELECT c_custkey, greatest(-999, least(999, {_tenths('c_acctbal')})) AS tenths FROM customer")
def clamp_quantise(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", clamp_tenths(quantise_tenths(F.col("c_acctbal"))).alias("tenths"))


@query(
    f"""WITH l AS (SELECT CASE event_id % 10 WHEN 0 THEN event_type WHEN 1 THEN ';1.0' WHEN 2 THEN concat(event_type, ';1') WHEN 3 THEN concat(event_type, ';1.23') WHEN 4 THEN concat(repeat('x', 101), ';1.0')
      ELSE concat(event_type, ';', {_text(_SIGNED)}) END AS line FROM events),
    p AS (SELECT CASE WHEN contains(line, ';') THEN line[1:instr(line, ';') - 1] END AS name, line[instr(line, ';') + 1:] AS v FROM l)
    SELECT CASE WHEN name IS NULL OR name = '' OR octet_length(encode(name)) > 100 THEN 'bad_name' WHEN NOT regexp_matches(v, '{VALUE}') THEN 'bad_value' ELSE 'ok' END AS status, count(*) AS n FROM p GROUP BY 1"""
)
def validation_split(spark, sf_dir):
    kind, name = F.col("event_id") % 10, F.col("event_type")
    bad = [name, F.lit(";1.0"), F.concat(name, F.lit(";1")), F.concat(name, F.lit(";1.23")), F.lit("x" * 101 + ";1.0")]
    line = F.col("value")
    for i, x in enumerate(bad):
        line = F.when(kind == i, x).otherwise(line)
    return measurements.classified(_event_lines(spark, sf_dir).select(line.alias("value"))).groupBy("status").agg(F.count("*").alias("n"))


def _difference(left: str, right: str) -> str:
    return f"SELECT *, 'left' AS side FROM (({left}) EXCEPT ALL ({right})) UNION ALL SELECT *, 'right' AS side FROM (({right}) EXCEPT ALL ({left}))"


_LESS = "(SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_custkey % 7 <> 0)"


@query(_difference(_lines("c_mktsegment", "c_acctbal", "customer"), _lines("c_mktsegment", "c_acctbal", _LESS)))
def answers_differ(spark, sf_dir):
    """The answer from partial states against one that lacks some rows of two segments: these two differ, on either side."""
    less = _table(spark, sf_dir, "customer").where("c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_custkey % 7 <> 0")
    fewer = stats.station_stats(measurements.from_table(less, "c_mktsegment", "c_acctbal"))
    return checks.difference(report.report_lines(partial_final_merge(spark, sf_dir)), report.report_lines(fewer))


_BY_TWO = "CAST(c_custkey // 2 AS VARCHAR)"
_FLOAT_LINES = f"""SELECT station, concat(station, '=', {_text('mn')}, '/', {_text('mean')}, '/', {_text('mx')}) AS line
    FROM (SELECT {_BY_TWO} AS station, CAST(floor(min(v) * 10 + 0.5) AS BIGINT) AS mn, CAST(floor(sum(v) / count(*) * 10 + 0.5) AS BIGINT) AS mean, CAST(floor(max(v) * 10 + 0.5) AS BIGINT) AS mx
    FROM (SELECT c_custkey, c_acctbal AS v FROM customer) GROUP BY 1)"""


def _by_two() -> Column:
    """Two rows for each key, so that the order of a sum in doubles cannot matter."""
    return whole_div(F.col("c_custkey"), F.lit(2)).cast("string")


@query(f"SELECT concat('{{', coalesce(string_agg(line, ', ' ORDER BY station), ''), '}}') AS report FROM ({_FLOAT_LINES})")
def float_report(spark, sf_dir):
    return report.float_report(checks.float_stats(_table(spark, sf_dir, "customer").select(_by_two().alias("station"), F.col("c_acctbal").alias("v"))))


@query(_difference(f"SELECT line FROM ({_lines(_BY_TWO, 'c_acctbal', 'customer')})", f"SELECT line FROM ({_FLOAT_LINES})"))
def reports_differ(spark, sf_dir):
    """The exact report of tenths against that of cents in doubles, both taken apart again: the entries that differ."""
    exact = report.report(stats.station_stats(_measured(spark, sf_dir, "customer", _by_two(), "c_acctbal")))
    return checks.difference(report.split_report(exact), report.split_report(float_report(spark, sf_dir)))


@query("SELECT label, n FROM (SELECT event_type AS label, count(value) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1) WHERE least <= most")
def timing_counts_approx(spark, sf_dir):
    """The approximate summary: its median is tested by rank, here only that it lies between the least and the most."""
    return stats.timing_summary_approx(_table(spark, sf_dir, "events"), "event_type", "value").where("median BETWEEN least AND most").select("label", "n")


@query(
    """SELECT name, CASE WHEN name IS NULL OR octet_length(encode(name)) NOT BETWEEN 1 AND 100 OR contains(name, ';') OR contains(name, chr(10)) THEN 'bad_name' WHEN bool_or(mean IS NULL OR abs(mean) > 99.9) THEN 'bad_mean' WHEN count(*) > 1 THEN 'repeated_name' END AS fault
    FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 50 = 1 THEN concat(c_name, ';') ELSE c_name END AS name, c_acctbal / 100 AS mean FROM customer) GROUP BY 1 HAVING fault IS NOT NULL"""
)
def station_faults(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 50 == 1, F.concat("c_name", F.lit(";"))).otherwise(F.col("c_name"))
    return generator.station_faults(_table(spark, sf_dir, "customer").select(name.alias("name"), (F.col("c_acctbal") / 100).alias("mean")))


@query(_stats("event_type", "value", "events"))
def streaming_station_stats(spark, sf_dir):
    return drained(streaming_stats(stream_table(spark, sf_dir, "events"), "event_type", "value"))


@query(f"SELECT station, mn, {_MEAN} AS mean, mx, s, c FROM (SELECT event_type AS station, CAST(min(t) AS INTEGER) AS mn, CAST(max(t) AS INTEGER) AS mx, CAST(sum(t) AS BIGINT) AS s, count(*) AS c FROM (SELECT event_type, {_SIGNED} AS t FROM events) GROUP BY 1)")
def streaming_text_stats(spark, sf_dir):
    """Written as lines of text that end in a carriage return and a line feed, and read as a stream."""
    path = scratch_path(spark, "stream-lines")
    _event_lines(spark, sf_dir).select("value").write.option("lineSep", "\r\n").text(path)
    return drained(streaming_stats(stream_lines(spark, path)))


_GENERATED = 200_000


def _generated(dimension: str, count: int) -> str:
    states = f"(SELECT station, min(tenths) AS mn, max(tenths) AS mx, CAST(sum(tenths) AS BIGINT) AS s, count(*) AS c FROM ({generator.sql_rows(_GENERATED, dimension, count)}) GROUP BY 1)"
    return f"SELECT station, mn, {_MEAN} AS mean, mx, s, c FROM {states}"


@query(_generated("SELECT n_nationkey AS number, n_name AS name, n_nationkey * 37 % 450 / 10.0 - 14.4 AS mean FROM nation", 25))
def generated_stats(spark, sf_dir):
    """Rows about the nations as stations."""
    n = F.col("n_nationkey")
    dimension = _table(spark, sf_dir, "nation").select(n.cast("long").alias("number"), F.col("n_name").alias("name"), (n * 37 % 450 / 10 - 14.4).alias("mean"))
    return stats.station_stats(generator.generate(spark, _GENERATED, dimension=dimension))


@query(_generated(generator.sql_stations(), generator.STATIONS))
def generated_source_stats(spark, sf_dir):
    """Rows of the Python data source, with the stations made by rule."""
    spark.dataSource.register(generator.MeasurementSource)
    return stats.station_stats(spark.read.format("measurements").option("rows", str(_GENERATED)).load())
