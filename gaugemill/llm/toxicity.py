"""Toxicity scores by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Marks of a text are its lower-cased words, the first 4 to 9 bytes of its words, and a few patterns, hashed into 2**21
buckets. A mark gives up to three features: that it occurs, that it does so at least twice, and that it makes up at least one
in a hundred of the words. Voters are the lexicon features that go most clearly with the label in the fitting rows, and
all patterns. The label model takes each voter's rates of firing on either class as unknown, and the given label as one more
voter that may be wrong; expectation-maximisation estimates the rates, and the voters' correlations that remain within
a class lower the weight of voters that repeat each other. A logistic classifier over the best features is then trained
on the posteriors.

Only rows whose id is not held out (crc32 of the id as text, modulo 4, is 2) are ever used to learn. The classifier is fitted on the
FIT_ROWS such rows that come first by a hash of their id; this is the only bound. All texts are scored whole, in
one pass without a shuffle. The model is at most TERMS weights, which is what the tasks are sent.

Defined cases: null and empty texts have no features and get the score of the intercept. A null id is not held out.
Labels that are null are not used; of several labels of an id the largest counts. Repeated rows are scored alike. Extra columns are not looked at. Without any usable label of either class
every score is the share of toxic labels, or 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm.bytewise import WORD_BYTE, Prefix, mixed, pieces, spans
from gaugemill.llm.common import map_pandas, materialize, table

FIT_ROWS = 4000
TERMS = 4096
VOTERS = 96
#: Least log-likelihood ratio of a feature that is used: about one in 10,000 by chance.
CLEAR = 15.0
ROUNDS = 15
BUCKET_BITS = 21
PREFIXES = (4, 5, 6, 7, 8, 9)
DENSE = 0.01
CUT = 0.3
MOST_SHIFT = 3.0
#: Patterns and the bucket each of them has to itself at the end of the table.
PATTERNS = ("!!", "***", "$$$", "%%%", "shout", "stutter")
BUCKETS = 1 << BUCKET_BITS
MARKS = BUCKETS + len(PATTERNS)
#: Features: occurs, twice or more, dense.
KINDS = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def patterns(text: str) -> list[int]:
    found = [p in text for p in PATTERNS[:4]] + [text.isupper(), _stutters(text)]
    return [BUCKETS + i for i, x in enumerate(found) if x]


def _stutters(text: str) -> bool:
    words = text.split()
    return any(a == b == c for a, b, c in zip(words, words[1:], words[2:], strict=False))


def marks(low: list[bytes], used: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of every occurrence of a word or prefix that is used; and the number of words of each text."""
    data = WORD_BYTE[np.frombuffer(b" ".join(low) + b" ", np.uint8)]
    starts, ends = spans(data != 0)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), starts, side="right")
    docs, buckets, h = [], [], Prefix(data)
    for k in (0, *PREFIXES):
        ok = slice(None) if not k else ends - starts >= k
        s, e = starts[ok], ends[ok] if not k else starts[ok] + k
        bucket = (mixed(h(s, e) + np.uint64(k)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        keep = slice(None) if used is None else used[bucket]
        docs.append(doc[ok][keep])
        buckets.append(bucket[keep])
    return np.concatenate(docs), np.concatenate(buckets), np.bincount(doc, minlength=len(low))


def features(texts: list[str | None], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), each pair once and in order, found piece by piece; used: which marks matter, or None for all."""
    low = [(t or "").lower().encode() for t in texts]
    out = [np.empty(0, np.int64)]
    for a, b in pieces([len(t) for t in low]):
        docs, buckets, n_words = marks(low[a:b], used)
        found = [(i, x) for i in range(b - a) for x in patterns(texts[a + i] or "") if used is None or used[x]]
        docs, buckets = np.append(docs, [i for i, _ in found]).astype(np.int64), np.append(buckets, [x for _, x in found]).astype(np.int64)
        pair, times = np.unique((docs << 32) | buckets, return_counts=True)
        docs, feature = pair >> 32, (pair & 0xFFFFFFFF) * KINDS
        kinds = [np.ones(times.size, bool), times > 1, times >= DENSE * n_words[docs]]
        out.append(np.sort(np.concatenate([((docs[k] + a) << 32) | (feature[k] + i) for i, k in enumerate(kinds)])))
    pair = np.concatenate(out)
    return pair >> 32, pair & 0xFFFFFFFF


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(MARKS * KINDS, np.float32)
        out[self.buckets] = self.weights
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, rates of firing (2 x voters), and each voter's weight after correlations; votes: rows x voters, bool."""
    v, q, n = votes.astype(float), np.where(given > 0, 0.95, 0.05), max(1, votes.shape[1])
    for _ in range(rounds):
        share = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        rates = np.stack([(v.T @ (1 - q) + 0.5) / ((1 - q).sum() + 1), (v.T @ q + 0.5) / (q.sum() + 1)])
        rest = v - q[:, None] * rates[1] - (1 - q)[:, None] * rates[0]
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        together = np.abs((rest.T @ rest) / len(v) / scale[:, None] / scale[None, :])
        own = 1 / np.maximum(1, np.where(together > 0.05, together, 0).sum(axis=0))
        own *= min(1.0, 12 / n) ** 0.5  # many weak voters that stay silent must not outvote the label by number
        fired, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        right = np.clip([(q * given).sum() / q.sum(), ((1 - q) * (1 - given)).sum() / (1 - q).sum()], 0.6, 0.99)
        stated = np.where(given > 0, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1]))
        q = sigmoid(np.log(share / (1 - share)) + stated + v @ (own * fired) + (1 - v) @ (own * silent))
    return q, rates, own


def logistic(docs: np.ndarray, terms: np.ndarray, n_terms: int, target: np.ndarray, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept over binary features given as (row, term) pairs; soft targets."""
    w, b, n = np.zeros(n_terms), float(np.log(target.mean() / (1 - target.mean()))), len(target)
    m, s, mb, sb = np.zeros(n_terms), np.zeros(n_terms), 0.0, 0.0
    for i in range(1, steps + 1):
        off = sigmoid(np.bincount(docs, w[terms], n) + b) - target
        g, gb = np.bincount(terms, off[docs], n_terms) + ridge * w, off.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate, fix, fix2 = 0.1 / (1 + i / 100), 1 - 0.9**i, 1 - 0.99**i
        w -= rate * (m / fix) / (np.sqrt(s / fix2) + 1e-8)
        b -= rate * (mb / fix) / (np.sqrt(sb / fix2) + 1e-8)
    return w, b


def surprise(on: np.ndarray, off: np.ndarray, n_on: float, n_off: float) -> np.ndarray:
    """Log-likelihood ratio (G squared) of each feature's counts in the two classes against a common rate."""
    share = np.stack([on, off, n_on - on, n_off - off])
    used, n = on + off, n_on + n_off
    even = np.stack([used * n_on, used * n_off, (n - used) * n_on, (n - used) * n_off]) / n
    return 2 * (share * np.log(np.where(share > 0, share / np.maximum(even, 1e-12), 1))).sum(axis=0)


def train(rows: list[tuple[int, np.ndarray]]) -> Model:
    """rows: (label, distinct features) of each fitting row.

    The intercept is then moved so that CUT lies where rows that a half of the fitting rows has not seen are told apart best.
    """
    model, margins, given = train_once(rows), [], []
    for fold in (0, 1) if model.buckets.size else ():
        half = train_once(rows[fold::2])
        weights = half.table()
        margins += [float(weights[x].sum()) + half.intercept for _, x in rows[1 - fold :: 2]]
        given += [y for y, _ in rows[1 - fold :: 2]]
    model.intercept += shift(np.array(margins), np.array(given)) if margins else 0.0
    return model


def shift(margins: np.ndarray, given: np.ndarray) -> float:
    """What to add to margins so that logit(CUT) is in the middle of the cuts with the best sum of both classes' rates."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], given[order] > 0
    if not y.any() or y.all():
        return 0.0
    gain = np.cumsum(~y) / (~y).sum() - np.cumsum(y) / y.sum()  # with the cut after each place
    best = np.flatnonzero(gain[:-1] >= gain[:-1].max() - 1e-12) if m.size > 1 else np.empty(0, int)
    if not best.size:
        return 0.0
    cut = (m[best[0]] + m[best[-1] + 1]) / 2
    return float(np.clip(np.log(CUT / (1 - CUT)) - cut, -MOST_SHIFT, MOST_SHIFT))


def train_once(rows: list[tuple[int, np.ndarray]], terms: int = TERMS, voters: int = VOTERS) -> Model:
    given = np.array([y for y, _ in rows], float)
    if not len(rows) or given.min() == given.max():
        share = np.clip(given.mean() if len(rows) else 0, 1e-9, 1 - 1e-9)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    size = MARKS * KINDS
    counts = np.zeros((2, size), np.float32)
    for y, x in rows:
        counts[int(y > 0)][x] += 1
    clear = np.zeros(size, np.float32)
    for at in range(0, size, 1 << 18):
        off, on = counts[:, at : at + (1 << 18)].astype(float)
        clear[at : at + (1 << 18)] = surprise(on, off, given.sum(), (1 - given).sum())
    best = np.flatnonzero(clear >= CLEAR)
    best = best[np.argsort(-clear[best], kind="stable")[:terms]]
    best = np.union1d(best, np.arange(BUCKETS * KINDS, size))
    off, on = counts[:, best]
    z = np.where(on / given.sum() > off / (1 - given).sum(), clear[best], -clear[best])
    place = np.full(size, -1, np.int32)
    place[best] = np.arange(best.size)
    columns = [p[p >= 0] for p in (place[x] for _, x in rows)]
    docs, cols = np.repeat(np.arange(len(rows)), [x.size for x in columns]), np.concatenate(columns)
    lexicon = np.argsort(-z, kind="stable")[:voters]
    chosen = np.union1d(lexicon[z[lexicon] > 0], np.flatnonzero(best >= BUCKETS * KINDS))
    votes = np.zeros((len(rows), best.size), bool)
    votes[docs, cols] = True
    target, _, _ = label_model(votes[:, chosen], given)
    weights, intercept = logistic(docs, cols, best.size, np.clip(target, 0.005, 0.995))
    return Model(best, weights, intercept)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic); the driver gets the distinct features of at most so many rows."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    order = F.xxhash64("_id")
    first = F.broadcast(usable.orderBy(order, "_id").limit(rows))  # at most FIT_ROWS pairs

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, feature = features(batch["text"].tolist())
            cut, ids = np.searchsorted(doc, np.arange(len(batch) + 1)), feature.astype(np.int32)
            yield pd.DataFrame({"id": batch["_id"], "y": batch["_y"], "x": [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    found = map_pandas(docs.select("doc_id", "text").join(first, F.col("doc_id") == F.col("_id")).select("_id", "_y", "text"), distinct, "id long, y int, x binary")
    got = found.orderBy(F.xxhash64("id"), "id", "x").limit(rows).collect()
    return train([(r.y, np.frombuffer(r.x, np.int32)) for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS weights

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, intercept = sent.value.table(), sent.value.intercept
        used = (weights != 0).reshape(-1, KINDS).any(axis=1)
        for batch in batches:
            texts = batch["text"].tolist()
            doc, feature = features(texts, used)
            total = np.bincount(doc, weights[feature].astype(np.float64), len(texts)) + intercept
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": sigmoid(total)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = map_pandas(rows, work, "doc_id string, held_out boolean, score double")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return materialize(score(docs, fit(docs, table(spark, sf_dir, "labels"))), "toxicity")
