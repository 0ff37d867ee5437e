"""Near-duplicates by 64-bit SimHash fingerprints, linked through BK-trees.

Each distinct fingerprint is handled once, however many rows have it. A BK-tree keys a node's children by their Hamming distance to it; a
search follows only edges within the radius of the distance found. The trees are sharded: fingerprints that differ in
at most RADIUS bits agree in one of RADIUS + 1 blocks of bits, so a fingerprint goes to the tree of each of its
blocks, and no link is lost. A shard with more than HOT fingerprints is divided again in the same way by its other bits. A
tree is built and searched where its shard arrives, as the set of all trees has no size bound that would allow to
broadcast it. From a shard come links to the first fingerprint of each cluster, never all pairs; components are found over
the links of all shards.

Defined cases: null and empty texts have fingerprint 0 and are linked like any other. Fewer words than a shingle form one
shingle. Rows with equal texts have one fingerprint and so one component. Null ids never name a component, unless all of its ids are null. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from gaugemill.llm.bytewise import as_bytes
from gaugemill.llm.common import boxed, map_pandas, materialize, row_key, sent_if_small, table, unboxed
from gaugemill.llm.components import roots

SHINGLE = 3
RADIUS = 3
HOT = 256
BITS = 64
SEED = 42
RUN = 1 << 16
#: Shards of up to so many fingerprints are searched one by one.
PLAIN = 48
NOTHING = np.uint64((1 << 64) - 1)
FIRST = 24
#: For documents whose five-word shingle sets resemble each other: least similarity, bits that may differ then, shards of a text, hashes kept.
SIMILARITY, WIDE, SHARDS, KEPT = 0.8, 28, 5, 128
#: Shingles of a shard for each of its texts, from which it is large.
LONG = 1024
#: The estimate from which a pair is put to the test; one of 0.8 is estimated lower with a chance of about 1e-6.
LOW = 0.6

_hash = partial(xxh64_intdigest, seed=SEED)


def fingerprint(text, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key, fp (the 64 bits as a long) of docs(doc_id, text)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "fp": fp})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), row_key(docs).alias("key"), "text")
    return map_pandas(rows, work, "doc_id string, key binary, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


class BKTree:
    """children[i] maps a distance to the child of node i at that distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = new
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most radius away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                stack += [c for e, c in edges.items() if d - radius <= e <= d + radius]
            else:
                stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found


class PackedBKTree:
    """The same tree over an array of values, built and searched level by level for all values at once.

    A child's edge and its parent make one key; the keys are sorted, so the edges within the radius are a range of them.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        n = values.size
        parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at, rest = np.zeros(n, np.int64), np.arange(1, n)
        while rest.size:  # those at one node with one distance: the first becomes its child, the others go on there
            d = np.bitwise_count(values[rest] ^ values[at[rest]]).astype(np.int64)
            _, first, which = np.unique(at[rest] * (BITS + 1) + d, return_index=True, return_inverse=True)
            child = rest[first][which]
            parent[rest[first]], edge[rest[first]] = at[rest[first]], d[first]
            at[rest] = child
            rest = rest[child != rest]
        keys = parent[1:] * (BITS + 1) + edge[1:]
        order = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[order], order + 1

    def pairs(self, radius: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i > j, of values at most radius apart; queries go in blocks, so that the frontier stays bounded."""
        n = self.values.size
        start = 0
        while start < n:  # the first batches are small, as those after them gain by what they join
            step = max(1, min(block, (start + 16) * 64) // n)
            query = np.arange(start, min(n, start + step))
            start += step
            node = np.zeros(query.size, np.int64)
            while query.size:
                d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                hit = (d <= radius) & (query > node)
                yield query[hit], node[hit]
                low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
                times = high - low
                query = np.repeat(query, times)
                offset = np.arange(query.size) - np.repeat(np.cumsum(times) - times, times)
                node = self.children[np.repeat(low, times) + offset]


def joint_pairs(values: np.ndarray, radius: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i > j, of values at most radius apart, through a BK-tree of the different values that all values walk together.

    For a radius that lets most values follow most edges: each node is compared with an array of those that reach it, and holds all places of
    its value, so equal values make no chain. Pairs come in batches of about block.
    """
    order = np.argsort(values, kind="stable")
    values = values[order]
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    ends = np.append(heads[1:], values.size).tolist()
    tree = PackedBKTree(values[heads])
    bounds = np.searchsorted(tree.keys, np.arange(heads.size + 1) * (BITS + 1)).tolist()
    edges, children, heads = (tree.keys % (BITS + 1)).tolist(), tree.children.tolist(), heads.tolist()
    stack, found, size = [(0, 0, np.arange(values.size), np.zeros(values.size, np.int16))], [], 0
    while stack:
        node, edge, query, d = stack.pop()
        first = int(np.searchsorted(query, heads[node]))  # nodes below come later in the order, and pairs are taken at the earlier one
        query = query[first:][np.abs(d[first:] - edge) <= radius] if node else query
        d = np.bitwise_count(values[query] ^ values[heads[node]]).astype(np.int16)
        hit = query[d <= radius]
        for held in range(heads[node], ends[node]):
            found.append((hit[np.searchsorted(hit, held, side="right") :], held))
            size += found[-1][0].size
            if size >= block:
                yield _placed(order, found)
                found, size = [], 0
        stack += [(children[k], edges[k], query, d) for k in range(bounds[node], bounds[node + 1])]
    yield _placed(order, found)


def _placed(order: np.ndarray, found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i > j, of pairs of places in order, given as (array, one place)."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = order[np.concatenate([many for many, _ in found])]
    y = order[np.repeat([one for _, one in found], [many.size for many, _ in found])]
    return np.maximum(x, y), np.minimum(x, y)


def close_pairs(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i > j, of values at most radius apart, through a BK-tree, batch by batch."""
    if values.size > PLAIN:
        yield from joint_pairs(values, radius) if radius > BITS // 4 else PackedBKTree(values).pairs(radius)
        return
    tree, found = BKTree(), []
    for i, value in enumerate(values.tolist()):
        found += [(i, j) for j in tree.within(value, radius)]
        tree.add(value)
    yield tuple(np.array(found, np.int64).reshape(-1, 2).T)


def stars(values: np.ndarray, radius: int, nodes: list, agree=None) -> list[tuple[int, int]]:
    """Links from each node to the first of its cluster: pairs within the radius that agree form it; joined pairs aren't asked again."""
    parent = list(range(len(nodes)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in close_pairs(values, radius):
        if agree and i.size:
            label = np.array([top(k) for k in range(len(nodes))])
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            ok = agree(i, j)
            i, j = i[ok], j[ok]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(x), top(y)
            parent[max(a, b)] = min(a, b)
    return [(nodes[i], nodes[t]) for i in range(len(nodes)) if (t := top(i)) != i]


def _blocks(bits: Column, low: int, high: int, parts: int) -> Column:
    """Array of (part, its bits) for [low, high) cut into parts."""
    edges = [low + (high - low) * i // parts for i in range(parts + 1)]
    cut = lambda a, b: F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*(F.struct(F.lit(i).alias("part"), cut(a, b).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """a, b: links between the fingerprints of distinct(fp) that are at most radius bits apart, through shard trees."""
    width = BITS // (radius + 1)
    shards = distinct.select("fp", F.explode(_blocks(F.col("fp"), 0, BITS, radius + 1)).alias("s")).select("fp", F.xxhash64("s.part", "s.bits").alias("shard"), F.col("s.part").alias("part"))
    big = materialize(shards.groupBy("shard").count().where(F.col("count") > hot).select("shard", F.lit(True).alias("big")), "simhash-big")
    keyed = shards.join(big, "shard", "left")
    # what is left of a fingerprint when its shard's block is turned to the top
    turned = F.when(F.col("part") == radius, F.col("fp")).otherwise(F.col("fp").bitwiseAND(F.lit(0)))
    for i in range(radius + 1):
        by = BITS - width * (i + 1)
        rotated = F.col("fp") if by == 0 else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", BITS - by))
        turned = F.when(F.col("part") == i, rotated).otherwise(turned)
    again = keyed.where("big").withColumn("_t", turned).select("fp", "shard", F.explode(_blocks(F.col("_t"), 0, BITS - width, radius + 1)).alias("s"))
    rows = keyed.where("big is null").select("shard", "fp").unionByName(again.select(F.xxhash64("shard", "s.part", "s.bits").alias("shard"), "fp"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = fp = np.empty(0, np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                shard, fp = np.concatenate((shard, batch["shard"].to_numpy())), np.concatenate((fp, batch["fp"].to_numpy()))
            heads = np.flatnonzero(np.concatenate(([True], np.diff(shard) != 0))) if shard.size else np.empty(0, int)
            ends = np.append(heads[1:], shard.size) if heads.size else heads
            if batch is not None and heads.size:  # the last shard may go on
                heads, ends = heads[:-1], ends[:-1]
            out = []
            for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    out += stars(fp[a:b].view(np.uint64), radius, fp[a:b].tolist())
            done = ends[-1] if ends.size else 0
            shard, fp = shard[done:], fp[done:]
            yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_pandas(rows.repartition(parts, "shard").sortWithinPartitions("shard", "fp"), search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, key, fp, component_id (the smallest doc_id that links reach)."""
    rows = materialize(fingerprints(docs, shingle), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    top = roots(links(distinct.select("fp"), radius, hot), "simhash-links").withColumnRenamed("node", "fp")
    placed = distinct.join(top, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(placed.join(named, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(of, "fp").select("doc_id", "key", "fp", "component_id")


def shingle_hashes(text, shingle: int) -> np.ndarray:
    """64-bit hashes of the shingles of a text, repeats included."""
    words = as_bytes(text).lower().split()
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([_hash(b" ".join(words))] if words else [], np.uint64)
    return np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), RUN):
        bits = np.unpackbits(hashes[at : at + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63)


def sketches(docs: DataFrame, shingle: int, shards: int, kept: int) -> DataFrame:
    """doc_id, key, node (128-bit hash of the shingle set), size (of that), fp, shards (least shingle hashes) and sketch (binary: the kept least ones)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, key, text in batch.itertuples(index=False):
                hashes = shingle_hashes(text, shingle)
                every = np.unique(hashes)
                least = every[:kept]
                out.append((doc_id, key, xxh3_128_digest(every.tobytes()), every.size, _signed(majority(every)), least[:shards].view(np.int64).tolist() or [0], least.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "key", "node", "size", "fp", "shards", "sketch"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), row_key(docs).alias("key"), "text")
    return map_pandas(rows, work, "doc_id string, key binary, node binary, size int, fp long, shards array<long>, sketch binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def sketch_matrix(sketches_: list[bytes], kept: int) -> np.ndarray:
    out = np.full((len(sketches_), kept), NOTHING)
    for row, raw in zip(out, sketches_, strict=True):
        row[: len(raw) // 8] = np.frombuffer(raw, np.uint64)
    return out


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of pairs of sets from rows of their least hashes; exact while a union has no more than a row."""
    kept = a.shape[1]
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    real = both != NOTHING
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    among = np.arange(2 * kept) - again.cumsum(axis=1) < kept  # of the least ones of the union
    union = (real & ~again & among).sum(axis=1)
    return np.where(union > 0, (again & among).sum(axis=1) / np.maximum(union, 1), 1.0)


def agreeing(matrix: np.ndarray, similarity: float):
    """A test of pairs of rows for similarity. A first look at FIRST hashes leaves out what is far below it."""

    def agree(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(i.size, bool)
        for at in range(0, i.size, 1 << 12):
            x, y = i[at : at + (1 << 12)], j[at : at + (1 << 12)]
            near = np.flatnonzero(resemblance(matrix[x, :FIRST], matrix[y, :FIRST]) >= similarity - 0.4)
            out[at + near] = resemblance(matrix[x[near]], matrix[y[near]]) >= similarity
        return out

    return agree


def reaches(common: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of a and b members with so many in common are that similar; empty ones are."""
    union = a + b - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0) >= similarity


def near_in_size(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6


def proposals(fp: np.ndarray, sizes: np.ndarray, matrix: np.ndarray, shard: np.ndarray, nodes: list, similarity: float, radius: int, shards: int) -> tuple[list[tuple], np.ndarray]:
    """Of one shard's texts: links between those whose sets are whole in their sketches, and whether a text has a pair that only whole sets decide.

    A pair is looked at in the first shard that it shares. Sizes too far apart rule it out, and so does an estimate below LOW.
    """
    kept, first = matrix.shape[1], matrix[:, :shards]
    whole, unsure = sizes <= kept, np.zeros(len(nodes), bool)
    label, out = np.arange(len(nodes)), []
    proposed = agreeing(matrix, min(LOW, similarity))
    for i, j in close_pairs(fp, radius):
        known = whole[i] & whole[j]
        ask = near_in_size(sizes[i], sizes[j], similarity) & np.where(known, label[i] != label[j], ~(unsure[i] & unsure[j]))
        i, j, known = i[ask], j[ask], known[ask]
        for at in range(0, i.size, 1 << 12):
            x, y, k = (v[at : at + (1 << 12)] for v in (i, j, known))
            here = ~((first[x][:, :, None] == first[y][:, None, :]) & (first[x] < shard)[:, :, None]).any(axis=(1, 2))
            k, x, y = k[here], x[here], y[here]
            rest = np.flatnonzero(~k & ~(unsure[x] & unsure[y]))
            rest = rest[proposed(x[rest], y[rest])]
            unsure[x[rest]] = unsure[y[rest]] = True
            k &= label[x] != label[y]
            x, y = x[k], y[k]
            width = int(max(sizes[x].max(), sizes[y].max())) if x.size else 0
            both = np.sort(np.concatenate((matrix[x, :width], matrix[y, :width]), axis=1), axis=1)
            common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NOTHING)).sum(axis=1)
            ok = reaches(common, sizes[x], sizes[y], similarity)
            for a, b in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if label[a] != label[b]:
                    label[label == max(label[a], label[b])] = min(label[a], label[b])
                    out.append((nodes[a], nodes[b]))
    return out, unsure


def exact_links(sets: list[np.ndarray], nodes: list, similarity: float, block: int = 1 << 22) -> list[tuple[int, int]]:
    """Links that join the texts as all pairs of that similarity would; pairs that are joined aren't asked again."""
    sizes = np.array([x.size for x in sets])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    values, rank = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, out = np.zeros(values.size, bool), np.arange(len(nodes)), []
    for k in range(1, len(nodes)):
        near = np.flatnonzero(near_in_size(sizes[:k], sizes[k], similarity))
        mark[rank[bounds[k] : bounds[k + 1]]] = True
        for look in (0, 1):  # at one of each class, then at all of those not joined by it
            asked = near[label[near] != label[k]]
            if look == 0:
                asked = asked[np.unique(label[asked], return_index=True)[1]]
            if not asked.size:
                break
            for part in np.split(asked, np.flatnonzero(np.diff(np.cumsum(sizes[asked]) // block)) + 1):
                common = np.array([], np.int64)
                if part.size:
                    found = mark[np.concatenate([rank[bounds[j] : bounds[j + 1]] for j in part.tolist()])]
                    common = np.add.reduceat(found, np.concatenate(([0], np.cumsum(sizes[part])[:-1])), dtype=np.int64)
                for j in part[reaches(common, sizes[part], sizes[k], similarity)].tolist():
                    if label[j] != label[k]:
                        label[label == max(label[j], label[k])] = min(label[j], label[k])
                        out.append((nodes[k], nodes[j]))
        mark[rank[bounds[k] : bounds[k + 1]]] = False
    return out


def by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """The shards of two and more rows of batches that are sorted by shard, batch by batch."""
    rest = None
    for batch in chain(batches, [None]):
        part = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if part is None or not len(part):
            continue
        s = part["shard"].to_numpy()
        heads = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        if batch is not None:  # the last shard may go on
            rest, heads = part.iloc[heads[-2] :], heads[:-1]
        yield [part.iloc[a:b] for a, b in zip(heads[:-1], heads[1:], strict=True) if b - a > 1]


def divided(rows: DataFrame, similarity: float, hot: int) -> DataFrame:
    """node, shard, least_hash of rows(node, size, least_hash): any two similar sets of a shard meet in one of the shards made of it.

    Sizes of similar sets lie in one class or in two that adjoin, so a cell holds two classes. A cell that is still too large
    is cut into blocks by hashes of its nodes, and each two blocks make a shard.
    """
    size_class = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.lit(float(np.log(1 / similarity) + 1e-6)))
    cells = rows.withColumn("_class", size_class).withColumn("cell", F.explode(F.array(F.col("_class"), F.col("_class") + 1)))
    blocks = cells.groupBy("least_hash", "cell").agg(F.ceil(F.greatest(F.count("*") / hot, F.sum("size") / (LONG * hot))).cast("int").alias("blocks"))
    placed = cells.join(blocks, ["least_hash", "cell"]).withColumn("own", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("node", F.xxhash64("least_hash", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "least_hash")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, radius: int = WIDE, shards: int = SHARDS, kept: int = KEPT, hot: int = 16 * HOT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, key, component_id, where Jaccard similarity of shingle sets links.

    A similarity of 0.8 leaves some ten of 64 bits different, too many for blocks of equal bits. So the shards here are the least
    shingle hashes: texts of similarity s share none of m with a chance of about (1 - s) ** m. Texts with equal
    sets are one. Shards with more than hot texts or LONG * hot shingles are divided without loss, see divided(). Sketches only propose pairs, but where they hold the whole sets; the sets of
    the other proposed texts are made again from their text, brought to the shard and compared there.
    """
    rows = materialize(sketches(docs, shingle, shards, kept), "similar-rows")
    distinct = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("size", "fp", "shards", "sketch"))), "similar-distinct")
    dealt = distinct.select("node", "size", F.explode("shards").alias("least_hash"))
    counts = dealt.groupBy("least_hash").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1").select("least_hash", ((F.col("n") > hot) | (F.col("total") > LONG * hot)).alias("big"))
    shared = materialize(dealt.join(counts, "least_hash"), "similar-shared")
    small = shared.where("not big").select("node", F.col("least_hash").alias("shard"), "least_hash")
    members = small.unionByName(divided(shared.where("big"), similarity, hot)).join(distinct.select("node", "size", "fp", "sketch"), "node")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in by_shard(batches):
            out = []
            for x in groups:
                nodes, shard = x["node"].tolist(), x["shard"].iloc[0]
                at = x["least_hash"].to_numpy(np.int64).view(np.uint64)[0]
                linked, unsure = proposals(x["fp"].to_numpy(np.int64).view(np.uint64), x["size"].to_numpy(np.int64), sketch_matrix(x["sketch"].tolist(), kept), at, nodes, similarity, radius, shards)
                out += [(a, b, shard, False) for a, b in linked]
                out += [(nodes[k], nodes[k], shard, True) for k in np.flatnonzero(unsure).tolist()]
            yield pd.DataFrame(out, columns=["a", "b", "shard", "unsure"])

    sorted_by = lambda df: df.repartition(parts, "shard").sortWithinPartitions("shard", "node")
    found = materialize(map_pandas(sorted_by(members.select("shard", "least_hash", "node", "size", "fp", "sketch")), propose, "a binary, b binary, shard long, unsure boolean"), "similar-found")
    unsure = found.where("unsure").select("shard", F.col("a").alias("node"))
    wanted = materialize(distinct.join(unsure.select("node").distinct(), "node", "left_semi").select(F.col("key").alias("_key"), "node"), "similar-wanted")
    texts = docs.select(row_key(docs).alias("key"), "text").join(sent_if_small(wanted, F.lit(128)), F.col("key") == F.col("_key")).select("node", "text").dropDuplicates(["node"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "hashes": [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch["text"]]})

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in by_shard(batches):
            out = []
            for x in groups:
                out += exact_links([np.frombuffer(h, np.uint64) for h in x["hashes"]], x["node"].tolist(), similarity)
            yield pd.DataFrame(out, columns=["a", "b"])

    sets = map_pandas(texts, whole, "node binary, hashes binary")
    decided = map_pandas(sorted_by(unsure.join(sets, "node").select("shard", "node", "hashes")), decide, "a binary, b binary")
    top = roots(found.where("not unsure").select("a", "b").unionByName(decided), "similar-links")
    placed = distinct.select("node", "least").join(top, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = materialize(placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id", "root"), "similar-components")
    return rows.select("doc_id", "key", "node").join(of, "node").select("doc_id", "key", "root", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stand for their group of similar documents: that of its smallest doc_id; of equal ids the smallest row key, once."""
    found = similar_documents(docs, **how)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nul"), F.col("doc_id"), F.col("key"))).alias("x"))
    keep = materialize(first.select(F.col("x.key").alias("_keep")), "similar-keep")
    keyed = boxed(docs)
    kept = keyed.join(keep, F.col("_key") == F.col("_keep"), "left_semi")
    if found.groupBy("key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_key"])
    return unboxed(kept)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
