"""Synthetic measurements: uniform stations, values about each station's mean with a standard deviation of 10.

Every value depends on the seed and the row's number alone, through an integer mix that Spark's functions, numpy and SQL all
compute alike. So neither the number of partitions nor a lost executor changes a row, and both sources give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gaugemill.functions.fixedpoint import clamp_tenths, quantise_tenths, valid_name, whole_div

ROWS_PER_CHUNK = 1_000_000
SEED = 0x5EED
SPREAD = 10.0
STATIONS = 413
#: Means of stations lie within so many degrees of zero.
MEAN_LIMIT = 99.9
FACTOR, WORD = 0x45D9F3B, 1 << 32

#: Station names are made of two syllables and an ending, so that they have 4 to 26 bytes, some of them not ASCII.
SYLLABLES = ["ab", "ber", "cho", "dür", "el", "fjo", "gra", "hé", "is", "ja", "køl", "lun", "mar", "nord", "os", "pri", "qua", "ré", "sol", "tam", "ur", "vesz", "wí", "xan", "yo", "zag"]
ENDINGS = ["", "a", "-on-the-Water", " City", "ville", "村", " am See", "ów", " del Mar", "bucht"]


def station_name(number: int) -> str:
    n = len(SYLLABLES)
    more = f" {number // n**2}" if number >= n**2 else ""
    return SYLLABLES[number // n % n].capitalize() + SYLLABLES[number % n] + ENDINGS[number % len(ENDINGS)] + more


def stations(spark: SparkSession, count: int = STATIONS, path: str | None = None) -> DataFrame:
    """number, name, mean: from lines of name;mean in a file, or made by rule. Stations are a small dimension."""
    if path:
        lines = spark.read.option("lineSep", "\n").text(path).where("value <> ''")
        rows = lines.select(F.substring_index("value", ";", 1).alias("name"), F.substring_index("value", ";", -1).try_cast("double").alias("mean"))
        return checked(rows).select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("number"), "name", "mean")
    return spark.createDataFrame([(i, station_name(i), i * 37 % 450 / 10 - 14.4) for i in range(count)], "number long, name string, mean double")


def station_faults(rows: DataFrame) -> DataFrame:
    """name, fault of rows(name, mean) that no dimension may have: bad_name, bad_mean or repeated_name."""
    bad_mean = F.col("mean").isNull() | F.isnan("mean") | (F.abs("mean") > MEAN_LIMIT)
    fault = F.when(F.col("name").isNull() | ~valid_name(F.col("name")), "bad_name").when(F.max(bad_mean), "bad_mean").when(F.count("*") > 1, "repeated_name")
    return rows.groupBy("name").agg(fault.alias("fault")).where("fault is not null")


def checked(rows: DataFrame) -> DataFrame:
    """rows, or an error that names the first faults."""
    found = station_faults(rows).orderBy("name").limit(5).collect()
    if found:
        raise ValueError("stations: " + ", ".join(f"{r.name!r} has a {r.fault}" for r in found))
    return rows


def stride_sample(df: DataFrame, order: str, keep: int) -> DataFrame:
    """The rows number i * n div keep for i below keep, in an order; all rows if keep isn't from 1 to n. For small tables."""
    n = df.count()
    if not 0 < keep <= n:
        return df
    at = "_" * max(map(len, df.columns)) + "_at"
    numbered = df.withColumn(at, (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
    wanted = df.sparkSession.range(keep).select(whole_div(F.col("id") * n, F.lit(keep)).alias(at))
    return numbered.join(wanted, at).drop(at)


def scrambled(x, xor, right):
    """32 bits stirred in 64-bit integers, without overflow; xor and right (shift) are those of ints, arrays or Columns."""
    for _ in range(2):
        x = xor(x, right(x, 16)) * FACTOR % WORD
    return xor(x, right(x, 16))


def stream_of(seed: int, what: str) -> int:
    """The start of one stream of draws."""
    h = seed % WORD
    for b in what.encode():
        h = scrambled(h ^ b, int.__xor__, int.__rshift__)
    return h


def uniform(seed: int, what: str, row: Column) -> Column:
    """A double in (0, 1) out of a row's number."""
    return (mixed(seed, what, row) + F.lit(0.5)) / F.lit(float(WORD))


def mixed(seed: int, what: str, row: Column) -> Column:
    low = (row + whole_div(row, F.lit(WORD)) * F.lit(FACTOR)) % WORD
    return scrambled(low.bitwiseXOR(F.lit(stream_of(seed, what))), lambda a, b: a.bitwiseXOR(b), F.shiftright)


def generate(spark: SparkSession, rows: int, seed: int = SEED, dimension: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """station, tenths: so many rows; values are rounded half up to tenths and kept within ±99.9. dimension: number (from 0), name, mean."""
    dimension = dimension if dimension is not None else stations(spark)
    count = dimension.count()
    row = F.col("id")
    normal = F.sqrt(-2 * F.log(uniform(seed, "radius", row))) * F.cos(2 * F.pi() * uniform(seed, "angle", row))
    base = spark.range(0, rows, 1, partitions or max(1, -(-rows // ROWS_PER_CHUNK)))
    picked = base.select((mixed(seed, "station", row) % count).alias("number"), (normal * SPREAD).alias("noise"))
    joined = picked.join(dimension, "number")
    return joined.select(F.col("name").alias("station"), clamp_tenths(quantise_tenths(F.col("mean") + F.col("noise"))).cast("int").alias("tenths"))


def sql_uniform(seed: int, what: str) -> str:
    """The same draw in SQL, over a column id."""
    x = f"xor((id + (id // {WORD}) * {FACTOR}) % {WORD}, {stream_of(seed, what)})"
    return f"({sql_scrambled(x)} + 0.5) / {WORD}.0"


def sql_scrambled(x: str) -> str:
    for _ in range(2):
        x = f"(xor({x}, ({x}) >> 16) * {FACTOR} % {WORD})"
    return f"xor({x}, ({x}) >> 16)"


def sql_rows(rows: int, dimension: str, count: int, seed: int = SEED) -> str:
    """What generate() gives, in SQL; dimension is a table of number, name, mean."""
    station = sql_scrambled(f"xor((id + (id // {WORD}) * {FACTOR}) % {WORD}, {stream_of(seed, 'station')})")
    noise = f"sqrt(-2 * ln({sql_uniform(seed, 'radius')})) * cos(2 * pi() * {sql_uniform(seed, 'angle')}) * {SPREAD}"
    value = "CAST(floor((mean + noise) * 10 + 0.5) AS BIGINT)"
    return f"SELECT name AS station, CAST(greatest(-999, least(999, {value})) AS INTEGER) AS tenths FROM (SELECT {station} % {count} AS number, {noise} AS noise FROM (SELECT range AS id FROM range({rows}))) JOIN ({dimension}) USING (number)"


def sql_stations(count: int = STATIONS) -> str:
    """What stations() gives for a count below 676, in SQL."""
    n = len(SYLLABLES)
    heads, tails, ends = ([f(x) for x in xs] for f, xs in ((str.capitalize, SYLLABLES), (str, SYLLABLES), (str, ENDINGS)))
    pick = lambda xs, i: f"({xs})[{i} + 1]"
    return f"SELECT i AS number, concat({pick(heads, f'(i // {n}) % {n}')}, {pick(tails, f'i % {n}')}, {pick(ends, f'i % {len(ENDINGS)}')}) AS name, i * 37 % 450 / 10.0 - 14.4 AS mean FROM range({count}) AS r(i)"


class _Chunk(InputPartition):
    def __init__(self, number: int, rows: int) -> None:
        self.number, self.rows = number, rows


class MeasurementReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.rows, self.seed, self.count = (int(str(options.get(k, d)).replace("_", "")) for k, d in (("rows", 1_000_000), ("seed", SEED), ("stations", STATIONS)))

    def partitions(self) -> list[InputPartition]:
        return [_Chunk(i, min(ROWS_PER_CHUNK, self.rows - i * ROWS_PER_CHUNK)) for i in range(-(-self.rows // ROWS_PER_CHUNK))]

    def read(self, partition: _Chunk) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = pa.array([station_name(i) for i in range(self.count)])
        first = partition.number * ROWS_PER_CHUNK
        for start in range(first, first + partition.rows, 65536):
            row = np.arange(start, min(start + 65536, first + partition.rows), dtype=np.int64)
            low = (row + row // WORD * FACTOR) % WORD
            station, radius, angle = (scrambled(low ^ stream_of(self.seed, x), np.bitwise_xor, np.right_shift) for x in ("station", "radius", "angle"))
            number, share = station % self.count, (np.stack([radius, angle]) + 0.5) / float(WORD)
            value = (number * 37 % 450) / 10 - 14.4 + np.sqrt(-2 * np.log(share[0])) * np.cos(2 * np.pi * share[1]) * SPREAD
            tenths = np.clip(np.floor(value * 10 + 0.5), -999, 999).astype(np.int32)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(number)), pa.array(tenths)], names=["station", "tenths"])


class MeasurementSource(DataSource):
    """spark.read.format("measurements").option("rows", "1_000_000"): the rows of generate(), a million to a partition."""

    @classmethod
    def name(cls) -> str:
        return "measurements"

    def schema(self) -> str:
        return "station string, tenths int"

    def reader(self, schema) -> MeasurementReader:
        return MeasurementReader(self.options)
