"""Delete later repeats of runs of lines, found by winnowing over line hashes.

A window is the shortest run of lines from a line on that has RUN lines, or WORDS words if these come sooner; its own text
decides where it ends. Of the line hashes of every window the smallest (the last of equal ones) is a fingerprint, so two documents that
share a window share the fingerprint chosen in it, at the same place. Only fingerprints that occur more than once are
followed. The windows about them, as far as those that chose them reach in both directions, are joined under 128-bit
hashes to the place where each stands first, never to all others; windows that follow each other in both places are
extended both ways to maximal runs, and these are what is deleted.

A line is deleted if it lies in a window that also stands earlier: in a document with a smaller doc_id, or further up in the
same one. So RUN equal lines go, and so does one long line. This is judged on the input, and what stands first is always kept.

Defined cases: lines are separated by \\n, and empty lines count as lines. Null text has no lines and stays null; an empty text is
one empty line. Documents of fewer than RUN lines and fewer than WORDS words are unchanged. Null ids come after all others; equal ids are ordered by a hash of the
row, and equal rows count as one document, so that each of them keeps what the first keeps. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from gaugemill.llm.common import map_pandas, materialize, short_key, table

RUN = 4
#: Words are runs without ASCII white space, as bytes.split() finds them.
WORDS = 50
DOC = ["nul", "id", "key"]


def split_lines(text) -> list[str]:
    return text.split("\n") if isinstance(text, str) else []


def window_ends(counts: np.ndarray, run: int, words: int) -> np.ndarray:
    """The line after each window, for the first lines of a document whose windows are whole; ends never go down."""
    total = np.concatenate(([0], counts.astype(np.int64).cumsum()))
    starts = np.arange(counts.size)
    ends = np.minimum(starts + run, np.maximum(np.searchsorted(total, total[:-1] + words), starts + 1))
    return ends[ends <= counts.size]


def winnowed(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen positions, and the first and last start of the windows that chose each of them."""
    if not ends.size:
        none = np.empty(0, np.int64)
        return none, none, none
    starts = np.arange(ends.size)
    at = starts.copy()
    for step in range(1, int((ends - starts).max())):
        there = starts + step < ends
        reach = starts[there] + step
        at[there] = np.where(hashes[reach] <= hashes[at[there]], reach, at[there])
    heads = np.flatnonzero(np.concatenate(([True], np.diff(at) != 0)))
    return at[heads], heads, np.append(heads[1:], at.size) - 1


def line_hashes(docs: DataFrame) -> DataFrame:
    """nul, id, key, hashes (binary, 8 bytes a line), counts (binary, words in 4 bytes a line) of docs(doc_id, text)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [split_lines(t) for t in batch["text"]]
            hashes = [np.array([xxh64_intdigest(x) for x in ls], np.uint64).tobytes() for ls in lines]
            counts = [np.array([len(x.encode().split()) for x in ls], np.int32).tobytes() for ls in lines]
            yield batch[DOC].assign(hashes=hashes, counts=counts)

    rows = docs.select(F.col("doc_id").isNull().alias("nul"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), short_key(docs).alias("key"), "text")
    return map_pandas(rows, work, "nul boolean, id long, key long, hashes binary, counts binary")


def later_windows(hashed: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """nul, id, key, start, size (lines) of every window that also stands earlier, and where it stands first."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for nul, i, key, raw, counted in batch[[*DOC, "hashes", "counts"]].itertuples(index=False):
                h = np.frombuffer(raw, np.uint64)
                ends = window_ends(np.frombuffer(counted, np.int32), run, words)
                sizes = (ends - np.arange(ends.size)).astype(np.int32)
                for at, first, last in zip(*(x.tolist() for x in winnowed(h, ends)), strict=True):
                    out.append((int(h[at : at + 1].view(np.int64)[0]), nul, i, key, first, h[first : ends[last]].tobytes(), sizes[first : last + 1].tobytes()))
            yield pd.DataFrame(out, columns=["fp", *DOC, "start", "around", "sizes"])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for nul, i, key, start, around, sizes in batch[[*DOC, "start", "around", "sizes"]].itertuples(index=False):
                out += [(xxh128_digest(around[8 * j : 8 * (j + n)]), nul, i, key, start + j, n) for j, n in enumerate(np.frombuffer(sizes, np.int32).tolist())]
            yield pd.DataFrame(out, columns=["window", *DOC, "start", "size"])

    chosen = materialize(map_pandas(hashed, choose, "fp long, nul boolean, id long, key long, start int, around binary, sizes binary"), "lines-chosen")
    shared = materialize(chosen.groupBy("fp").count().where("count > 1").select("fp"), "lines-shared")
    windows = materialize(map_pandas(chosen.join(shared, "fp", "left_semi"), extend, "window binary, nul boolean, id long, key long, start int, size int"), "lines-windows")
    place = F.struct(*DOC, "start")
    first = windows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that the join stands between two exchanges and Spark can split a hot window's
    return windows.join(materialize(first, "lines-first"), "window").where(place > F.col("first")).select(*DOC, "start", "size", "first")


def repeated_runs(hashed: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """nul, id, key, start, n_lines, and the first occurrence's first_nul, first_id, first_key, first_start: maximal runs."""
    later = later_windows(hashed, run, words).distinct().withColumn("shift", F.col("start") - F.col("first.start"))
    same = Window.partitionBy(*DOC, "first.nul", "first.id", "first.key", "shift").orderBy("start")
    runs = later.withColumn("island", F.col("start") - F.row_number().over(same))
    grouped = runs.groupBy(*DOC, F.col("first.nul").alias("first_nul"), F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"), "shift", "island")
    found = grouped.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.min("first.start").alias("first_start"))
    return found.withColumn("n_lines", F.col("end") - F.col("start")).drop("shift", "island", "end")


def deduplicated(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, text (what is kept), n_lines, n_removed."""
    hashed = materialize(line_hashes(docs), "lines-hashed")
    gone = repeated_runs(hashed, run, words).groupBy(*(F.col(c).alias(f"_{c}") for c in DOC)).agg(F.collect_set(F.struct("start", "n_lines")).alias("runs"))
    rows = docs.select(F.col("doc_id").isNull().alias("nul"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), short_key(docs).alias("key"), "text")
    # by shuffle at any size: texts move once, and runs, which grow with the data, are never sent to all tasks
    joined = rows.join(materialize(gone, "lines-gone").hint("merge"), (F.col("key") == F.col("_key")) & (F.col("id") == F.col("_id")) & (F.col("nul") == F.col("_nul")), "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for nul, i, text, runs in batch[["nul", "id", "text", "runs"]].itertuples(index=False):
                lines, kept = split_lines(text), text
                if runs is not None and len(runs):
                    edge = np.zeros(len(lines) + 1, np.int32)
                    np.add.at(edge, [x["start"] for x in runs], 1)
                    np.add.at(edge, [x["start"] + x["n_lines"] for x in runs], -1)
                    stay = [x for x, n in zip(lines, edge.cumsum(), strict=False) if not n]
                    n_removed, kept = len(lines) - len(stay), "\n".join(stay)
                else:
                    n_removed = 0
                out.append((None if nul else str(i), kept, len(lines), n_removed))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_lines", "n_removed"])

    cut_rows = map_pandas(joined.select("nul", "id", "text", "runs"), cut, "doc_id string, text string, n_lines long, n_removed long")
    return cut_rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return materialize(found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")), "lines")


OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
f AS (SELECT doc_id, i, list(line) OVER four AS g, list(n) OVER four AS ns FROM c
  WINDOW four AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
z AS (SELECT doc_id, i, g, CASE WHEN ns[1] >= 50 THEN 1 WHEN len(ns) >= 2 AND ns[1] + ns[2] >= 50 THEN 2
  WHEN len(ns) >= 3 AND ns[1] + ns[2] + ns[3] >= 50 THEN 3 WHEN len(ns) = 4 THEN 4 END AS size FROM f),
r AS (SELECT doc_id, i, size, row_number() OVER (PARTITION BY g[1:size] ORDER BY doc_id, i) AS k FROM z WHERE size IS NOT NULL),
d AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(size)) AS j FROM r WHERE k > 1)),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(d.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE d.i IS NULL) AS kept
  FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.i = d.i GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id)
"""
