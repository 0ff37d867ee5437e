"""Remove every byte that lies in a repeated string of LENGTH bytes, found with a hash-compared suffix sort.

Of the 32-byte strings within each LENGTH bytes, the one with the smallest hash is an anchor, so equal strings of LENGTH bytes
have equal anchors at the same place, and two or so anchors in 400 bytes stand for all suffixes. An anchor's context reaches
as far as any such string about it. Contexts that are equal as a whole (hot groups of copies), told by a 128-bit cut of their SHA-256,
are counted first, with partial aggregation, and one of each kind goes on; anchors with only one context are done. The different contexts of an anchor come together
with their bytes and are sorted twice: as suffixes from the anchor on, and by what stands before the anchor, whose
branchings give the starts at which matches can begin. Two suffixes are compared through
prefix polynomial hashes: a binary search over lengths finds the common extension in some nine steps, in a merge sort that handles
all groups at once. Neighbours in the order that share LENGTH bytes or more are repeats. Every two neighbours of both orders are
verified by their bytes, what they share and which comes first, and so is every repeat; if hashes had erred the piece is done again by its bytes.

An anchor with more than MOST different contexts isn't sorted in one task: slices of its contexts, and where slices differ smaller ones,
down to strings of LENGTH bytes, are dealt out by a 128-bit cut of their SHA-256 and counted, which gives the same spans.

Texts are shuffled twice, to be joined with the positions that are wanted of them, at every size alike; nothing is broadcast.

Defined cases: text is judged as UTF-8 bytes, null as none. Overlapping occurrences count, also within a document; no
match crosses documents. Documents shorter than LENGTH are matched by nothing. Equal rows are documents of their own, so
both lose what they share. Null ids are ids like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm.bytewise import PIECE, Prefix, as_bytes, mixed, pieces, spans
from gaugemill.llm.common import drop, map_pandas, materialize, short_key, table

LENGTH = 400
#: About so many bytes of contexts are given on at once.
OUT_BYTES = 8 << 20
GRAM = 32
MOST = 1024
PARTS = 5
PLACE_BITS = 26
PLACE = np.uint64((1 << PLACE_BITS) - 1)
DOC = ["nul", "id", "key"]
DOC_TYPES = "nul boolean, id long, key long"


def anchors(data: np.ndarray, windows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of data (uint8); windows tells where strings of length bytes may start."""
    n = data.size - gram + 1
    width = length - gram + 1
    if n < width or not windows.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(n)
    h = mixed(Prefix(data)(at, at + gram))
    low = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    low[:n] = (h & ~PLACE) | (PLACE - at.astype(np.uint64))  # of equal hashes the last counts
    low = low.reshape(-1, width)
    to = np.minimum.accumulate(low, axis=1).ravel()
    since = np.ascontiguousarray(np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(since[: n - width + 1], to[width - 1 : n])[windows[: n - width + 1]]
    place = (PLACE - (least & PLACE)).astype(np.int64)
    place = place[np.concatenate(([True], np.diff(place) != 0))]
    return place, h[place].view(np.int64)


def document_anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, positions, hashes) for each text that has anchors."""
    for a, b in pieces([len(t) for t in texts]):
        if b - a == 1 and len(texts[a]) > PIECE:
            data, found = np.frombuffer(texts[a], np.uint8), []
            for start in range(0, len(data) - length + 1, PIECE):
                part = data[start : start + PIECE + length - 1]
                place, h = anchors(part, np.arange(part.size) <= part.size - length, length, gram)
                found.append((place + start, h))
            place, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
            yield a, place, np.concatenate([h for _, h in found])[first]
            continue
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        offsets = np.cumsum([0, *(len(t) for t in texts[a:b])])
        edge = np.zeros(data.size + 1, np.int32)
        for o, t in zip(offsets, texts[a:b], strict=False):
            if len(t) >= length:
                edge[o] += 1
                edge[o + len(t) - length + 1] -= 1
        place, h = anchors(data, edge.cumsum()[:-1] > 0, length, gram)
        cut = np.searchsorted(place, offsets)
        for i in np.flatnonzero(np.diff(cut)):
            yield a + int(i), place[cut[i] : cut[i + 1]] - offsets[i], h[cut[i] : cut[i + 1]]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").isNull().alias("nul"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), short_key(docs).alias("key"), "text")


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each anchor of keyed documents: its hash, the hash and extent of its context, and where it is."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = [as_bytes(t) for t in batch["text"]], []
            nul, ids, keys = (batch[c].to_numpy() for c in DOC)
            for i, place, h in document_anchors(texts, length, gram):
                text = texts[i]
                left, right = np.minimum(place, length - gram), np.minimum(len(text) - place, length)
                context = b"".join([digest(text[p - x : p + y]) for p, x, y in zip(place.tolist(), left.tolist(), right.tolist(), strict=True)])
                two = np.frombuffer(context, np.int64).reshape(-1, 2)
                out.append(pd.DataFrame({"anchor": h, "c1": two[:, 0] ^ left, "c2": two[:, 1], "nul": nul[i], "id": ids[i], "key": keys[i], "pos": place.astype(np.int32), "before": left.astype(np.int16), "after": right.astype(np.int16)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return map_pandas(docs, work, f"anchor long, c1 long, c2 long, {DOC_TYPES}, pos int, before short, after short")


def by_document(rows: DataFrame, what: list[str], name: str) -> DataFrame:
    """rows gathered by document: _nul, _id, _key and items, an array of the named columns; it is written."""
    grouped = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in DOC)).agg(F.collect_list(F.struct(*what)).alias("items"))
    return materialize(grouped, name)


def with_items(docs: DataFrame, items: DataFrame, how: str) -> DataFrame:
    """docs joined with their items."""
    on = (F.col("key") == F.col("_key")) & (F.col("id") == F.col("_id")) & (F.col("nul") == F.col("_nul"))
    return docs.join(items, on, how)


def in_order(text: bytes, x: np.ndarray, y: np.ndarray, common: np.ndarray, left: np.ndarray, right: np.ndarray, back: bool) -> bool:
    """Whether the suffixes (back: the prefixes read backwards) at x share just so many bytes with those at y and aren't greater; left and right: their sizes."""
    for i, j, n, m, k in zip(x.tolist(), y.tolist(), common.tolist(), left.tolist(), right.tolist(), strict=True):
        if back:
            if text[i - n : i] != text[j - n : j] or (n < m and (n == k or text[i - n - 1] >= text[j - n - 1])):
                return False
        elif text[i : i + n] != text[j : j + n] or (n < m and (n == k or text[i + n] >= text[j + n])):
            return False
    return True


class Contexts:
    """Contexts of anchors in one buffer, their groups, and comparisons of what stands before or from a place."""

    def __init__(self, texts: list[bytes], before: np.ndarray, group: np.ndarray) -> None:
        self.text = b"".join(texts)
        self.data = np.frombuffer(self.text, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        self.start = ends - [len(t) for t in texts]
        self.end, self.anchor, self.group = ends, self.start + before, group
        self.hash = Prefix(self.data)

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Length of the common extension of the places x and y, at most most, by binary search over prefix hashes."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash(x - mid, x) == self.hash(y - mid, y) if back else self.hash(x, x + mid) == self.hash(y, y + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


def merge_sort(group: np.ndarray, less) -> np.ndarray:
    """The order of items within their groups (equal numbers stand together); less(i, j) compares arrays of items.

    Bottom-up: in each round every item finds its rank in the neighbouring run by binary search, all items at once.
    """
    n = group.size
    order, at = np.arange(n), np.arange(n)
    heads = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    sizes = np.diff(np.append(heads, n))
    head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    place = at - head
    run = 1
    while (active := np.flatnonzero(size > run)).size:
        p, h, s = place[active], head[active], size[active]
        mine = p // run
        first = mine % 2 == 0
        other = np.minimum((mine ^ 1) * run, s)
        low, high = other.copy(), np.minimum(other + run, s)
        item = order[active]
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) >> 1
            there = order[h[todo] + mid]
            # how many of the other run come before: smaller ones, and for the second run equal ones too
            goes = np.where(first[todo], less(there, item[todo]), ~less(item[todo], there))
            low[todo], high[todo] = np.where(goes, mid + 1, low[todo]), np.where(goes, high[todo], mid)
        to = h + np.minimum(mine, mine ^ 1) * run + (p - mine * run) + (low - other)
        new = order.copy()
        new[to] = item
        order, run = new, run * 2
    return order


def branch_depths(order: np.ndarray, group: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, depth): the lengths that an item shares with some other of its group; shared[k]: of the k-th in order with the one before."""
    items, depths = [], []
    g, o, s = group[order].tolist(), order.tolist(), shared.tolist()
    for steps in (range(len(o)), range(len(o) - 1, -1, -1)):
        forward, stack, last = steps.step > 0, [], None
        for k in steps:
            if g[k] != last:
                stack, last = [], g[k]
            else:
                d = s[k] if forward else s[k + 1]
                while stack and stack[-1] >= d:
                    stack.pop()
                stack.append(d)
                items += [o[k]] * len(stack)
                depths += stack
    pair = np.unique((np.array(items, np.int64) << 32) | np.array(depths, np.int64))
    return pair >> 32, pair & 0xFFFFFFFF


def class_starts(shared: np.ndarray, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First place in the order from which on all up to place share at least depth; shared is below 0 where a group begins."""
    table, start, n = [shared], place.copy(), 1
    while n < shared.size:
        last = table[-1]
        table.append(np.minimum(last, np.concatenate((np.full(n, -1), last[:-n]))))
        n *= 2
    for level in range(len(table) - 1, -1, -1):  # least of the 2 ** level values up to a place
        start = np.where(table[level][start] >= depth, start - (1 << level), start)
    return start


def repeats(texts: list[bytes], before: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to): spans of each context, relative to its anchor, that recur in another context of its group.

    The suffixes at the anchors are sorted, and so are the texts before the anchors, read backwards. A match can begin
    where some context branches off from another one to the left; of the suffixes that begin there and have the same
    bytes up to the anchor, the order is that of the suffixes at their anchors, so these are not compared again.
    """
    c = Contexts(texts, before, group)
    left, right = c.anchor - c.start, c.end - c.anchor

    def back(i, j):
        return c.common(c.anchor[i], c.anchor[j], np.minimum(left[i], left[j]), True)

    def ahead(i, j):
        return c.common(c.anchor[i], c.anchor[j], np.minimum(right[i], right[j]), False)

    def left_less(i, j):
        n = back(i, j)
        x, y = c.anchor[i] - n - 1, c.anchor[j] - n - 1
        return np.where(n == left[i], n < left[j], (n < left[j]) & (c.data[np.maximum(x, 0)] < c.data[np.maximum(y, 0)]))

    def right_less(i, j):
        n, top = ahead(i, j), c.data.size - 1
        x, y = c.anchor[i] + n, c.anchor[j] + n
        return np.where(n == right[i], n < right[j], (n < right[j]) & (c.data[np.minimum(x, top)] < c.data[np.minimum(y, top)]))

    def neighbours(order, extension):
        a, b = order[:-1], order[1:]
        return np.concatenate(([-1], np.where(group[a] == group[b], extension(a, b), -1)))

    def most(order, shared):
        out = np.empty(order.size, np.int64)
        out[order] = np.maximum(shared, np.append(shared[1:], -1))
        return out

    ordered = merge_sort(group, right_less)
    rank, most_right = np.empty(group.size, np.int64), most(ordered, neighbours(ordered, ahead))
    rank[ordered] = np.arange(group.size)
    order = merge_sort(group, left_less)
    shared = neighbours(order, back)
    for of, size, extension, backwards in ((ordered, right, neighbours(ordered, ahead), False), (order, left, shared, True)):
        k = np.flatnonzero(extension >= 0)
        a, b = of[k - 1], of[k]
        if not in_order(c.text, c.anchor[a], c.anchor[b], extension[k], size[a], size[b], backwards):
            return repeats_by_bytes(texts, before, group, length)
    use = most(order, shared) + most_right >= length
    item, depth = branch_depths(order, group, shared)
    ok = use[item] & (depth + most_right[item] >= length)
    item, depth = item[ok], depth[ok]
    if not item.size:
        return item, item, item
    place = np.empty(group.size, np.int64)
    place[order] = np.arange(group.size)
    start = class_starts(shared, place[item], depth)
    by = np.lexsort((rank[item], depth, start))
    item, depth, start = item[by], depth[by], start[by]
    pair = np.flatnonzero((start[1:] == start[:-1]) & (depth[1:] == depth[:-1]))
    a, b, d = item[pair], item[pair + 1], depth[pair]
    n = d + ahead(a, b)
    hit = n >= length
    a, b, d, n = a[hit], b[hit], d[hit], n[hit]
    x, y = c.anchor[a] - d, c.anchor[b] - d
    if any(c.text[i : i + k] != c.text[j : j + k] for i, j, k in zip(x.tolist(), y.tolist(), n.tolist(), strict=True)):
        return repeats_by_bytes(texts, before, group, length)
    since = np.concatenate((-d, -d))
    return np.concatenate((a, b)), since, since + np.concatenate((n, n))


def repeats_by_bytes(texts: list[bytes], before: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What repeats() gives, from the bytes of all strings of length bytes; for pieces in which hashes collide."""
    seen: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault((int(group[i]), t[s : s + length]), []).append((i, s - int(before[i])))
    found = [(i, s, s + length) for x in seen.values() if len({i for i, _ in x}) > 1 for i, s in x]
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """nul, id, key, since, upto of the repeats among contexts(anchor, nul, id, key, pos, before, alone, bytes) of one anchor."""
    order = ["anchor", *DOC, "pos", "before", "alone", "bytes"]

    def spans_of(rows: pd.DataFrame) -> pd.DataFrame:
        group = np.cumsum(np.concatenate(([0], np.diff(rows["anchor"].to_numpy()) != 0)))
        who, since, upto = repeats(rows["bytes"].tolist(), rows["before"].to_numpy(np.int64), group, length)
        keep = rows["alone"].to_numpy(bool)[who]
        who, since, upto = who[keep], since[keep], upto[keep]
        pos = rows["pos"].to_numpy(np.int64)[who]
        return rows[DOC].iloc[who].assign(since=(pos + since).astype(np.int32), upto=(pos + upto).astype(np.int32))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame(columns=order)
        for batch in batches:
            rows = pd.concat([rest, batch[order]], ignore_index=True) if len(rest) else batch[order]
            a = rows["anchor"].to_numpy(np.int64)
            heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            done = int(heads[-1])  # the last anchor's contexts may go on
            sizes = np.add.reduceat(rows["bytes"].str.len().to_numpy(np.int64), heads) if done else np.empty(0)
            for i, j in pieces(sizes[:-1].tolist()):
                yield spans_of(rows.iloc[heads[i] : heads[j]])
            rest = rows.iloc[done:]
        if len(rest):
            yield spans_of(rest)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.select(*order).repartition(parts, "anchor").sortWithinPartitions("anchor")
    return map_pandas(dealt, work, f"{DOC_TYPES}, since int, upto int")


def class_slices(size: int, before: int, length: int, low: int, high: int, parts: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(low, high, from, to, core from, core to) for each part of a class of a context of size bytes.

    A class is the strings of length bytes that begin low and more, but less than high, bytes before the anchor; [from, to) holds all
    of them that lie in the context, the core is what every string of the class has in common.
    """
    edges = [low + (high - low) * i // parts for i in range(parts + 1)]
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        near, far = max(x, before + length - size), min(y - 1, before)  # strings have to lie in the context
        if x < y and near <= far:  # then what is common to the whole class does, too
            yield x, y, before - far, before - near + length, before - x, before - y + 1 + length


def counted_spans(contexts: DataFrame, length: int, gram: int, parts: int = PARTS) -> DataFrame:
    """What sorted_spans() gives, for anchors with very many contexts, with nothing brought together but counts.

    A search over how far matches reach, in all contexts at once: the strings of a context that begin close to each other are a class, and
    are taken as one slice. Slices that are equal as a whole are repeats. Of the others only classes go on whose core recurs; they are
    cut into smaller ones, until a class is one string. At each step a place where copies part leaves open only the class about it.
    """
    of, steps = [*DOC, "pos", "before"], length - gram + 1
    place = lambda *c: F.struct(*DOC, *c)

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for nul, i, key, pos, before, alone, low, high, text in batch[[*of, "alone", "low", "high", "bytes"]].itertuples(index=False):
                for lo, hi, a, b, x, y in class_slices(len(text), before, length, low, high, parts):
                    out.append((lo, hi, digest(text[x:y] + b"%d,%d" % (lo, hi)), digest(text[a:b]), nul, i, key, pos, before, alone, pos - before + a, pos - before + b))
            yield pd.DataFrame(out, columns=["low", "high", "core", "slice", *of, "alone", "since", "upto"])

    rows, width, found = contexts.select(*of, "alone", F.lit(0).alias("low"), F.lit(steps).alias("high"), "bytes"), steps, None
    while True:
        cut = materialize(map_pandas(rows, slices, f"low int, high int, core binary, slice binary, {DOC_TYPES}, pos int, before int, alone boolean, since int, upto int"), f"suffix-slices-{width}")
        # contexts overlap, so a slice may come twice from one place; only different places count
        kinds = cut.groupBy("core", "slice").agg(F.min(place("since")).alias("first"), F.max(place("since")).alias("last"), F.max("alone").alias("alone"), F.min(place("pos", "before", "low", "high")).alias("one"))
        kinds = materialize(kinds.withColumn("again", F.col("first") != F.col("last")), f"suffix-kinds-{width}")
        whole = cut.where("alone").join(kinds.where("again").select("core", "slice"), ["core", "slice"], "left_semi").select(*DOC, "since", "upto")
        found = whole if found is None else found.unionByName(whole)
        width = -(-width // parts)
        shared = kinds.groupBy("core").agg(F.count("*").alias("n"), F.max(F.col("alone") & ~F.col("again")).alias("open")).where("n > 1 and open").select("core")
        wanted = materialize(kinds.join(shared, "core", "left_semi").select("one.*", (F.col("alone") & ~F.col("again")).alias("alone")), f"suffix-open-{width}")
        if width == 1 or wanted.isEmpty():
            return found
        rows = contexts.select(*of, "bytes").join(wanted, of)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """nul, id, key, since, upto: spans of bytes of keyed documents, each of them covered by repeated strings; they may overlap."""
    found = materialize(anchor_rows(docs, length, gram), "suffix-anchors")
    context = ["anchor", "c1", "c2"]
    kinds = found.groupBy(*context).agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "pos", "before", "after")).alias("one"))
    kinds = materialize(kinds, "suffix-contexts")
    copies = found.join(kinds.where("n > 1").select(*context), context, "left_semi").where(F.col("before") + F.col("after") >= length)
    copies = copies.select(*DOC, (F.col("pos") - F.col("before")).cast("int").alias("since"), (F.col("pos") + F.col("after")).cast("int").alias("upto"))
    different = kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("fewest")).where("m > 1 and fewest = 1").select("anchor", (F.col("m") > most).alias("many"))
    wanted = kinds.join(different, "anchor").select("anchor", "many", (F.col("n") == 1).alias("alone"), "one.*")
    items = by_document(wanted, ["anchor", "many", "alone", "pos", "before", "after"], "suffix-wanted")
    copies = materialize(copies, "suffix-copies")
    drop(found, kinds)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, columns = [], 0, ["anchor", "many", *DOC, "pos", "before", "alone", "bytes"]
        for batch in batches:
            for nul, i, key, text, items_ in batch[[*DOC, "text", "items"]].itertuples(index=False):
                data = as_bytes(text)
                for x in items_:
                    context = data[x["pos"] - x["before"] : x["pos"] + x["after"]]
                    out.append((x["anchor"], x["many"], nul, i, key, x["pos"], x["before"], x["alone"], context))
                    size += len(context)
                    if size > OUT_BYTES:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=columns)

    # equal rows are one here; that their texts are equal is told by the digest of the text within the row's key
    joined = with_items(docs, items, "inner")
    joined = joined.dropDuplicates(DOC) if repeated_rows(docs) else joined
    contexts = materialize(map_pandas(joined.select(*DOC, "text", "items"), cut, f"anchor long, many boolean, {DOC_TYPES}, pos int, before int, alone boolean, bytes binary"), "suffix-bytes")
    drop(items)
    out = copies.unionByName(sorted_spans(contexts.where("not many"), length))
    if contexts.where("many").limit(1).count():
        out = out.unionByName(counted_spans(contexts.where("many"), length, gram))
    return out


def repeated_rows(docs: DataFrame) -> bool:
    """Whether some rows of docs are equal in id and key; each context's bytes are wanted from one row only."""
    rows, different = docs.agg(F.count("*"), F.count_distinct(*DOC)).first()
    return rows != different


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, kept (bytes), n_bytes, n_removed, n_spans."""
    rows = keyed(docs)
    items = by_document(repeated_spans(rows, length, gram, most), ["since", "upto"], "suffix-spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for nul, i, text, items_ in batch[["nul", "id", "text", "items"]].itertuples(index=False):
                data, runs = as_bytes(text), 0
                kept = data
                if items_ is not None and len(items_):
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, [x["since"] for x in items_], 1)
                    np.add.at(edge, [x["upto"] for x in items_], -1)
                    gone = edge.cumsum()[:-1] > 0
                    runs, kept = spans(gone)[0].size, np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((None if nul else str(i), kept, len(data), len(data) - len(kept), runs))
            yield pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    cut_rows = map_pandas(with_items(rows, items, "left").select("nul", "id", "text", "items"), cut, "doc_id string, kept binary, n_bytes long, n_removed long, n_spans long")
    return cut_rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return materialize(found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "suffixes")


#: Strings of 400 bytes are 800 hexadecimal digits; texts are cut into pieces first, since substr() looks through the whole of what it cuts.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, a, substr(x, 2 * a + 1, 1598) AS x FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399, 400)) AS a FROM d)),
w AS MATERIALIZED (SELECT doc_id, a + i AS i, md5_number(substr(x, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, a, x, unnest(range(length(x) // 2 - 399)) AS i FROM c)),
r AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS new FROM r),
k AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
s AS (SELECT doc_id, min(i) AS since, max(i) + 400 AS upto FROM k GROUP BY doc_id, k),
p AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY since), 0) AS before FROM s),
t AS (SELECT doc_id, any_value(x) AS x, sum(upto - since) AS n_removed, count(*) AS n_spans, max(upto) AS last,
  string_agg(substr(x, 2 * before + 1, 2 * (since - before)), '' ORDER BY since) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(d.x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN d.x ELSE kept || substr(d.x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, SHA-256 of what is kept) of each text, straight from the definition."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            g = t[s : s + length]
            seen[g] = seen.get(g, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(t) - len(kept), spans(gone[:-1])[0].size, hashlib.sha256(kept).hexdigest()))
    return out
