"""Find benchmark passages in documents with a distributed positional inverted index.

build_index() tokenises the documents segment by segment (about 2 MB of text each, never part of a document) and stores, for
every word of a segment, the ascending list of its positions; between documents the positions leave a gap, so no phrase crosses one.
Every window of the benchmark is filed under its rarest word, by the number of positions that the whole index has for it. A join
on that word brings each window to the segments that have it, and to no others; there the lists of its words, less their offsets,
are intersected from the rarest on. near() answers proximity questions from the same index. A hot word's list is split over all
segments, so no task meets more than one segment of it, and the windows of one rarest word come in rows of at most FILED.

Neither the benchmark nor its windows pass through the driver; repeated rows of it are asked once.

Defined cases: null and empty texts have no words and are not contaminated. An item of fewer words than the window, but not
none, is one window. A repeated item_id is one item; a null one is an item with an empty name. Repeated rows and null ids of documents
are answered row by row, ids of any size exactly. An empty benchmark hits nothing; an empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm.bytewise import WORD_BYTE, Prefix, as_bytes, mixed, pieces, spans
from gaugemill.llm.common import boxed, give_back, map_pandas, materialize, row_key, table, tidy, unboxed

WINDOW = 10
SEGMENT = 2 << 20
FILED = 256
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A segment's documents stand in its one row without a word.
INDEX = pa.schema([("seg", pa.int64()), ("word", pa.string()), ("positions", pa.binary()), ("ids", pa.binary()), ("nulls", pa.binary()), ("keys", pa.binary()), ("words", pa.binary())])
INDEX_TYPES = "seg long, word string, positions binary, ids binary, nulls binary, keys binary, words binary"


def item_words(text) -> list[str]:
    return [w.decode() for w in WORDS.findall(as_bytes(text).lower())]


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the pieces of data, one after another."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return offsets, data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]


def variable(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A string or binary array over numpy buffers."""
    return pa.Array.from_buffers(kind, offsets.size - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def postings(texts: list[bytes]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Words, positions of each (int32 bytes), and the number of words of each text; text i's words begin at words before it plus i."""
    low = WORD_BYTE[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    starts, ends = spans(low != 0)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    counts = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    at = (np.arange(starts.size) + doc).astype(np.int32)
    if not starts.size:
        return pa.array([], pa.string()), pa.array([], pa.binary()), counts
    first, second = (mixed(Prefix(low, i)(starts, ends) ^ (ends - starts).astype(np.uint64)) for i in (0, 1))
    order = np.argsort(first, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(first[order]) != 0)))
    check = second[order]
    if (np.minimum.reduceat(check, heads) != np.maximum.reduceat(check, heads)).any():  # two words share a hash
        out, data = {}, low.tobytes()
        for s, e, p in zip(starts.tolist(), ends.tolist(), at, strict=True):
            out.setdefault(data[s:e].decode(), []).append(p)
        return pa.array(list(out)), pa.array([np.array(p, np.int32).tobytes() for p in out.values()], pa.binary()), counts
    one = order[heads]
    words = variable(pa.string(), *gathered(low, starts[one], ends[one]))
    return words, variable(pa.binary(), 4 * np.append(heads, at.size), at[order].view(np.uint8)), counts


def build_index(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The stored index of docs(doc_id, text): a row for each segment and word, and one with the segment's documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [as_bytes(t) for t in batch.column("text").to_pylist()]
            ids, keys = batch.column("doc_id"), b"".join(batch.column("key").to_pylist())
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for a, b in pieces([len(t) for t in texts], segment):
                words, positions, counts = postings(texts[a:b])
                head = {"seg": [seg], "word": [None], "positions": [None], "ids": [ids[a:b].tobytes()], "nulls": [nulls[a:b].tobytes()], "keys": [keys[16 * a : 16 * b]], "words": [counts.tobytes()]}
                yield pa.RecordBatch.from_pydict(head, schema=INDEX)
                none = pa.nulls(len(words), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), seg)), words, positions, none, none, none, none], schema=INDEX)
                seg += 1

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").cast("long").alias("doc_id"), row_key(docs).alias("key"), "text")
    return materialize(rows.mapInArrow(tidy(build), INDEX_TYPES), "decontamination-index")


def windows_of(words: list[str], window: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1) if words else 0)}


def window_table(benchmark: DataFrame, window: int) -> DataFrame:
    """phrase (its words, a blank between them), items: each distinct window of benchmark(item_id, text) with the names of the items that have it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(" ".join(w), name) for name, text in zip(batch["item"], batch["text"], strict=True) for w in windows_of(item_words(text), window)]
            yield pd.DataFrame(rows, columns=["phrase", "item"])

    asked = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").distinct()
    found = map_pandas(asked, cut, "phrase string, item string").groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return materialize(found, "decontamination-asked")


def filed_under_rarest(index: DataFrame, asked: DataFrame, filed: int = FILED) -> tuple[DataFrame, DataFrame]:
    """The words of asked(phrase, items) that the index has; and word, asked: phrases whose rarest word that is, at most filed in a row.

    A phrase with a word that the index doesn't have is filed nowhere.
    """
    terms = asked.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    wanted = terms.select("word").distinct()
    counts = index.where("word is not null").select("word", (F.octet_length("positions") / 4).alias("n")).join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    counts = materialize(counts, "decontamination-terms")
    rarest = terms.join(counts, "word", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0")
    under = asked.join(rarest, "phrase").select(F.col("r.word").alias("word"), F.struct("phrase", "items").alias("a"), F.xxhash64("phrase").alias("h"))
    parts = under.groupBy("word").agg(F.ceil(F.count("*") / filed).alias("parts"))
    dealt = under.join(parts, "word").groupBy("word", F.pmod("h", "parts").alias("part")).agg(F.collect_list("a").alias("asked"))
    return counts.select("word"), materialize(dealt.select("word", "asked"), "decontamination-filed")


def by_segment(index: DataFrame, asked: DataFrame, filed: int = FILED) -> DataFrame:
    """All that a segment needs, and nothing else: its documents, the lists of the words that are asked for, the phrases filed under its words."""
    words, filed_ = filed_under_rarest(index, asked, filed)
    none = F.lit(None).cast(filed_.schema["asked"].dataType)
    lists = index.where("word is not null").join(words, "word", "left_semi").select(*index.columns, none.alias("asked"))
    asks = index.where("word is not null").select("seg", "word").join(filed_, "word").select("seg", "word", *(F.lit(None).cast("binary").alias(c) for c in INDEX.names[2:]), "asked")
    return lists.unionByName(asks).unionByName(index.where("word is null").withColumn("asked", none))


class Segment:
    """What by_segment() brings for one segment, taken apart."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        words = rows.column("word").to_pylist()
        head = words.index(None)
        cell = lambda c: rows.column(c)[head].as_py()
        self.seg, raw = cell("seg"), cell("keys")
        self.ids, self.counts = np.frombuffer(cell("ids"), np.int64), np.frombuffer(cell("words"), np.int64)
        self.ids = pa.array(self.ids, mask=np.frombuffer(cell("nulls"), bool))
        self.keys = [raw[i : i + 16] for i in range(0, len(raw), 16)]
        self.bases = np.concatenate(([0], np.cumsum(self.counts + 1)))
        is_list = rows.column("positions").is_valid().to_numpy()
        self.lists = {words[i]: np.frombuffer(rows.column("positions")[i].as_buffer(), np.int32) for i in np.flatnonzero(is_list).tolist()}
        asked = rows.column("asked").combine_chunks().drop_null().flatten()
        self.phrases, self.items = asked.field("phrase").to_pylist(), asked.field("items")
        self.number = {w: i for i, w in enumerate(self.lists)}
        self.sizes = np.array([p.size for p in self.lists.values()], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        #: All lists one after another; within (word, position) they ascend, so that one binary search looks into any of them.
        self.places = np.concatenate([(np.int64(i) << 32) | p for i, p in enumerate(self.lists.values())]) if self.lists else np.empty(0, np.int64)

    def has(self, word: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (word << 32) | position
        i = np.searchsorted(self.places, key)
        return (position >= 0) & (self.places[np.minimum(i, self.places.size - 1)] == key)

    def matches(self, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(phrase, position at which it begins, its length): the lists less their offsets, intersected from the rarest on, many phrases at once."""
        lengths: dict[int, list[tuple[int, list[int]]]] = {}
        for i, text in enumerate(self.phrases):
            ids = [self.number.get(w, -1) for w in text.split(" ")]
            if min(ids) >= 0:
                lengths.setdefault(len(ids), []).append((i, ids))
        for n, found in lengths.items():
            phrase, terms = np.array([i for i, _ in found]), np.array([x for _, x in found], np.int64)
            order = np.argsort(self.sizes[terms], axis=1, kind="stable")
            rare = terms[np.arange(len(terms)), order[:, 0]]
            for part in np.split(np.arange(len(terms)), np.flatnonzero(np.diff(np.cumsum(self.sizes[rare]) // most)) + 1):
                times = self.sizes[rare[part]]
                which = np.repeat(part, times)
                at = np.arange(which.size) + np.repeat(self.starts[rare[part]] - np.concatenate(([0], np.cumsum(times)[:-1])), times)
                begin = (self.places[at] & 0xFFFFFFFF) - order[which, 0]
                for k in range(1, n):
                    offset = order[which, k]
                    ok = self.has(terms[which, offset], begin + offset)
                    which, begin = which[ok], begin[ok]
                ok = begin >= 0
                yield phrase[which[ok]], begin[ok], n

    def documents(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, position, side="right") - 1


RESULT = "doc_id long, key binary, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def search(index: DataFrame, asked: DataFrame, filed: int = FILED) -> DataFrame:
    """A row for each document of the index: what of asked(phrase, items) occurs in it."""

    def find(rows: pa.Table) -> pa.Table:
        s = Segment(rows)
        hit, items = np.zeros(s.bases[-1], bool), [set() for _ in s.keys]
        for phrase, begin, n in s.matches():
            for k in range(n):
                hit[begin + k] = True
            for pair in np.unique((phrase << 32) | s.documents(begin)).tolist():
                items[pair & 0xFFFFFFFF].update(s.items[pair >> 32].as_py())
        n_hit = np.add.reduceat(hit, s.bases[:-1], dtype=np.int64) if s.keys else np.empty(0, np.int64)
        named = [",".join(sorted(x)) for x in items]
        columns = [s.ids, pa.array(s.keys, pa.binary()), pa.array(s.counts), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named], pa.string()), pa.array(n_hit > 0)]
        give_back()
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return by_segment(index, asked, filed).groupBy("seg").applyInArrow(find, RESULT)


def near(index: DataFrame, questions: DataFrame, within: int, filed: int = FILED) -> DataFrame:
    """doc_id, key, question, position: where the rarest word of a question has all its other words at most so many words away.

    questions(question, words): words as the index has them, an array. All of them have to stand in the same document; position counts its words from 0.
    """
    asked = questions.select(F.array_join(F.array_sort(F.array_distinct("words")), " ").alias("phrase"), F.col("question").cast("string").alias("q"))
    asked = asked.where("phrase <> ''").groupBy("phrase").agg(F.sort_array(F.collect_set("q")).alias("items"))

    def find(rows: pa.Table) -> pa.Table:
        s, out = Segment(rows), []
        for i, text in enumerate(s.phrases):
            found = proximity(s.lists, text.split(" "), within, s.bases)
            doc = s.documents(found)
            for name in s.items[i].as_py() if found.size else ():
                out += [(d, name, p) for d, p in zip(doc.tolist(), (found - s.bases[doc]).tolist(), strict=True)]
        which = [d for d, _, _ in out]
        return pa.Table.from_arrays([s.ids.take(pa.array(which, pa.int64())), pa.array([s.keys[d] for d in which], pa.binary()), pa.array([q for _, q, _ in out], pa.string()), pa.array([p for _, _, p in out], pa.int64())], names=["doc_id", "key", "question", "position"])

    return by_segment(index, asked, filed).groupBy("seg").applyInArrow(find, "doc_id long, key binary, question string, position long")


def proximity(lists: dict[str, np.ndarray], words: list[str], within: int, bases: np.ndarray) -> np.ndarray:
    """Positions of the rarest word that have every other word at most so many positions away; bases: where documents begin, and the end."""
    if any(w not in lists for w in words):
        return np.empty(0, np.int64)
    first, *others = sorted(words, key=lambda w: lists[w].size)
    found = lists[first].astype(np.int64)
    for word in others:
        p, doc = lists[word], np.searchsorted(bases, found, side="right") - 1
        i = np.searchsorted(p, np.maximum(found - within, bases[doc]))
        found = found[(i < p.size) & (p[np.minimum(i, p.size - 1)] <= np.minimum(found + within, bases[doc + 1] - 1))]
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, filed: int = FILED, segment: int = SEGMENT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated."""
    return search(build_index(docs, segment), window_table(benchmark, window), filed)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs in which no benchmark window occurs."""
    bad = materialize(decontaminate(docs, benchmark, **how).where("contaminated").select(F.col("key").alias("_bad")).distinct(), "decontamination-bad")
    keyed = boxed(docs)
    return unboxed(keyed.join(bad, F.col("_key") == F.col("_bad"), "left_anti"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
