"""What the pipeline operators share: written tables, bounded batches, row keys, word rules."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.sources.scratch import release, remove, scratch_path, shared_dir  # noqa: F401

#: Words of the mixing and fingerprint contracts: runs without ASCII white space.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
#: The most that is sent to all tasks for a join with documents.
SMALL_ROWS, SMALL_BYTES = 200_000, 32 << 20
#: What a Python worker is given at once, in bytes and rows; a longer row comes alone.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096

shared_path = scratch_path


@contextmanager
def bounded_batches(spark: SparkSession):
    """Plans made within send Python workers at most BATCH_BYTES at once, so that neither side holds more."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and no executor's loss undoes it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


_libc = ctypes.CDLL(None)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work over batches; what it has freed goes back to the system, as a Python worker outlives many tasks."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        for out in work(batches):
            yield out
            del out
            give_back()
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def map_pandas(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    return df.mapInPandas(tidy(work), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hashable(df: DataFrame) -> list[Column]:
    return [F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def row_key(df: DataFrame) -> Column:
    """128 bits over all columns of df that can be hashed; rows with equal keys count as equal rows."""
    of = _hashable(df)
    hexed = [F.lpad(F.hex(F.xxhash64(F.lit(salt), *of)), 16, "0") for salt in ("first", "second")]
    return F.unhex(F.concat(*hexed))


def short_key(df: DataFrame) -> Column:
    """64 bits over the same; only beside an id, to tell rows of one id apart."""
    return F.xxhash64(*_hashable(df))


def boxed(df: DataFrame) -> DataFrame:
    """_row (all columns of df, so that no name can clash) and _key."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), row_key(df).alias("_key"))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def few_rows(df: DataFrame, bound: int) -> bool:
    """Whether df has at most bound rows; reads no more than bound + 1 of them to the end."""
    return df.limit(bound + 1).count() <= bound


def sent_if_small(df: DataFrame, row_bytes: Column, rows: int = SMALL_ROWS, total: int = SMALL_BYTES) -> DataFrame:
    """df, marked to be broadcast if it has been counted and is within both bounds; otherwise the join is left to shuffles."""
    small = few_rows(df, rows) and (df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= total
    return F.broadcast(df) if small else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")
