"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Text: byte trigrams in 2**16 buckets under a multinomial model for each language, fitted on about FIT_PER_LANGUAGE rows of each
declared language, chosen by a hash (the only bound; every two- or three-letter code that any row declares is a language). The models
are broadcast and have at most MOST_CELLS numbers together, so there are fewer buckets if there are over 63 languages. A background, the square roots of all
languages' counts, smooths each model and stands beside them for any other language and for letters that are none. The likelihood is tempered, since trigrams of a text depend on each other.
Everything else is counted over all rows by grouped aggregation of the texts' posteriors: how often each language is declared as which,
which suffixes its addresses have, and which languages a host has. A host's prior, without the row itself, is smoothed by that
of its domain, and that by the prior over all rows. The posterior is the normalised product of the four.

Only one pass reads texts; it leaves some numbers for each row, and all joins are over these.

Defined cases: a text without letters, null or empty, gives no evidence; such rows are not kept, and their language is
what the other evidence says. Texts that the background fits best have a null language and are not kept. Missing or unsupported declarations, suffixes and hosts give no evidence (a null host is a host
of its own). Repeated rows count as often as they come. Without any supported declared language, language is null and
nothing is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm.bytewise import pieces
from gaugemill.llm.common import boxed, map_pandas, materialize, row_key, table, tidy, unboxed

FIT_PER_LANGUAGE = 1000
#: Buckets by number of bits, and the most numbers that all models have together (16 MB).
BITS, MOST_CELLS = 16, 1 << 22
#: How many trigrams of the background stand beside those counted for a language.
BACKGROUND = 1000.0
TEMPER = 0.25
MOST_GRAMS = 400
SMOOTH = 20.0
KEEP = 0.5

#: Letters in lower case and bytes of non-ASCII characters as they are, all others 32.
LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def buckets(languages: int) -> int:
    """How many buckets so many languages and the background have."""
    return min(1 << BITS, 1 << (MOST_CELLS // (languages + 1)).bit_length() - 1)


def grams(texts: list[bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram of the joined texts, whether it holds a letter, and the offsets of the texts.

    Two blanks stand before each text and belong to it, so no trigram has letters of two texts.
    """
    b = LETTER[np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)]
    bucket = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(33 - n_buckets.bit_length())
    return bucket, (b[:-2] != 32) | (b[1:-1] != 32) | (b[2:] != 32), np.cumsum([0, *(len(t) + 2 for t in texts)])


def primary(code: Column) -> Column:
    """The primary subtag of a language code, or null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(code)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def _encoded(texts) -> list[bytes]:
    return [t.lower().encode() if isinstance(t, str) else b"" for t in texts]


def fit(rows: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the buckets by them and, last, by the background, from rows(key, declared, text)."""
    counts = rows.groupBy("declared").count()
    found = counts.where(F.col("declared").isNotNull()).collect()  # one row for each code, of which there are 26 ** 2 + 26 ** 3
    languages = sorted(r["declared"] for r in found)
    size = buckets(len(languages))
    if not languages:
        return [], np.zeros((0, size))
    place = {x: i for i, x in enumerate(languages)}
    known = rows.sparkSession.createDataFrame([(r["declared"], place[r["declared"]], per_language / r["count"]) for r in found], "_code string, _place int, _share double")
    chosen = rows.join(F.broadcast(known), F.col("declared") == F.col("_code")).where(F.pmod(F.xxhash64(F.lit("fit"), "key"), F.lit(1 << 30)) / float(1 << 30) < F.col("_share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, part in batch.groupby("_place"):
                texts, sums = _encoded(part["text"]), np.zeros(size, np.int64)
                for a, b in pieces([len(t) for t in texts]):
                    bucket, letter, _ = grams(texts[a:b], size)
                    sums += np.bincount(bucket[letter], minlength=size)
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"language": language, "bucket": at, "n": sums[at]})

    counted = map_pandas(chosen.select("_place", "text"), count, "language int, bucket int, n long")
    got = materialize(counted, "language-counts").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most MOST_CELLS rows
    table_ = np.zeros((len(languages) + 1, size))
    table_[got["language"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    background = np.sqrt(table_.sum(axis=0) + 0.5)
    table_ += BACKGROUND * background / background.sum()
    table_ /= table_.sum(axis=1, keepdims=True)
    return languages, np.log(table_, out=table_)


def read_texts(rows: DataFrame, logs: np.ndarray) -> DataFrame:
    """rows without text, but with ll (tempered log likelihoods by language) and n (trigrams with a letter)."""
    sent = rows.sparkSession.sparkContext.broadcast(logs.astype(np.float32))  # at most MOST_CELLS x 4 bytes
    names = [c for c in rows.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _encoded(batch.column("text").to_pylist())
            n, ll = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(sent.value)))
            for a, b in pieces([len(t) for t in texts]):
                bucket, letter, starts = grams(texts[a:b], sent.value.shape[1])
                n[a:b] = np.add.reduceat(letter, starts[:-1], dtype=np.int64)
                for i, logs_of in enumerate(sent.value):
                    ll[a:b, i] = np.add.reduceat(logs_of[bucket] * letter, starts[:-1], dtype=np.float64)
            ll *= (TEMPER * np.minimum(n, MOST_GRAMS) / np.maximum(n, 1))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * ll.shape[1]), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, pa.array(n)], names=[*names, "ll", "n"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return rows.select(*names, "text").mapInArrow(tidy(work), f"{kinds}, ll array<double>, n long")


def identify(rows: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> DataFrame:
    """Per row of rows(key, declared, suffix, host, domain, text, ...): all columns but text, and language, posterior, kept.

    declared must be a primary subtag or null. Other columns must not be named ll, n, p, or begin with an underscore.
    """
    languages, logs = fit(rows, per_language)
    size = range(len(logs))
    extra = [c for c in rows.columns if c != "text"]
    if not languages:
        return rows.select(*extra, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))
    soft = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    normal = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    read = materialize(read_texts(rows, logs), "language-read").withColumn("p", normal(soft(F.col("ll"))))
    heard = read.where("n > 0")
    sums = [F.sum(F.col("p")[i]) for i in size]
    every = heard.agg(*sums).first()
    prior = [((x or 0.0) + 1.0) / (sum(y or 0.0 for y in every) + len(logs)) for x in every]

    def totals(by: list[str], name: str) -> DataFrame:
        keys = [F.col(c).alias(f"_{name}_{c}") for c in by]
        return materialize(heard.groupBy(*keys).agg(F.array(*sums).alias(f"_{name}")), f"language-{name}")

    def joined(df: DataFrame, by: list[str], name: str) -> DataFrame:
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{name}_{c}")) for c in by))
        return df.join(totals(by, name), on, "left").drop(*(f"_{name}_{c}" for c in by))

    out = read
    for by, name in ((["host", "domain"], "host"), (["domain"], "domain"), (["declared"], "stated"), (["suffix"], "suffix")):
        out = joined(out, by, name)
    zero, priors = F.array_repeat(F.lit(0.0), len(logs)), F.array(*(F.lit(x) for x in prior))
    counted = {name: F.coalesce(F.col(name), zero) for name in ("_host", "_domain", "_stated", "_suffix")} | {"_own": F.when(F.col("n") > 0, F.col("p")).otherwise(zero), "_prior": priors}
    out = out.withColumns(counted)
    out = out.withColumns({f"{name}_all": F.aggregate(name, F.lit(0.0), lambda s, y: s + y) for name in ("_host", "_domain", "_stated", "_suffix")})

    def score(i: Column) -> Column:
        at = lambda name: F.get(F.col(name), i)
        domain = (F.greatest(at("_domain") - at("_host"), F.lit(0.0)) + SMOOTH * at("_prior")) / (F.greatest(F.col("_domain_all") - F.col("_host_all"), F.lit(0.0)) + SMOOTH)
        host = (F.greatest(at("_host") - at("_own"), F.lit(0.0)) + SMOOTH * domain) / (F.greatest(F.col("_host_all") - F.when(F.col("n") > 0, 1.0).otherwise(0.0), F.lit(0.0)) + SMOOTH)
        # how likely a language is among those who state or have this, against its share of all
        given = lambda name: F.log((at(name) + SMOOTH * at("_prior")) / (F.col(f"{name}_all") + SMOOTH) / at("_prior"))
        stated = F.when(F.col("declared").isin(languages), given("_stated")).otherwise(0.0)
        suffix = F.when(F.col("suffix").isNotNull(), given("_suffix")).otherwise(0.0)
        return F.log(host) + at("ll") + stated + suffix

    scores = F.transform(F.sequence(F.lit(0), F.lit(len(logs) - 1)), score)
    out = out.withColumn("_post", scores).withColumn("_post", normal(soft(F.col("_post"))))
    best = F.array_max("_post")
    name = F.get(F.array(*(F.lit(x) for x in languages), F.lit(None).cast("string")), F.array_position("_post", best).cast("int") - 1)
    return out.select(*extra, name.alias("language"), best.alias("posterior"), ((F.col("n") > 0) & (best >= KEEP) & name.isNotNull()).alias("kept"))


def document_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) as evidence: lang is what is declared, source the host."""
    key = row_key(docs).alias("key")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), key, primary(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit("documents").alias("domain"), "text")


def page_rows(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as evidence: html's lang, the last label of the host, the host and its last two labels."""
    host = F.nullif(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    declared = primary(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), row_key(pages).alias("key"), declared.alias("declared"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), text.alias("text"))


def known_language(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose language is identified."""
    keep = materialize(identify(document_rows(docs), **how).where("kept").select(F.col("key").alias("_keep")).distinct(), "language-keep")
    keyed = boxed(docs)
    return unboxed(keyed.join(keep, F.col("_key") == F.col("_keep"), "left_semi"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id) and pages (page_id) together, so that each learns from the other's texts."""
    rows = document_rows(table(spark, sf_dir, "documents")).unionByName(page_rows(table(spark, sf_dir, "pages")))
    return identify(rows).select("doc_id", "page_id", "declared", "host", "language", "posterior", "kept")
