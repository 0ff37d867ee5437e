import random
import zlib

import pytest

from gaugemill.llm import sharding as s


def plain_capacity(sizes, shards):
    def ok(c):
        used, left = 1, c
        for x in sizes:
            if x > c:
                return False
            if x > left:
                used, left = used + 1, c
            left -= x
        return used <= shards

    return next(c for c in range(sum(sizes) + 1) if ok(c))


@pytest.mark.parametrize("seed", range(30))
def test_cut_is_contiguous_and_minimax(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 5, 20, rnd.randrange(1, 100)]) for _ in range(rnd.randrange(1, 60))]
    shards = rnd.randrange(1, 9)
    got = s.cut(sizes, shards)
    assert len(got) == len(sizes) and all(0 <= b - a for a, b in zip(got, got[1:])) and got[0] >= 0 and got[-1] < shards
    load = [sum(x for x, g in zip(sizes, got) if g == i) for i in range(shards)]
    assert max(load) == s.smallest_capacity(sizes, shards) == plain_capacity(sizes, shards)


def test_no_sizes():
    assert s.cut([], 3) == []


def check(rows, texts):
    assert sorted(map(str, texts)) == sorted(str(r.doc_id) for r in rows) if not isinstance(texts, dict) else True
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    for i in range(24):
        assert sorted(r.slot for r in rows if r.shard == i) == list(range(sum(r.shard == i for r in rows)))


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = s.op6_sharding(spark, small).collect()
    check(rows, docs)
    of = {}
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert of.setdefault(data, r.shard) == r.shard
    load = [sum(r.size for r in rows if r.shard == i) for i in range(24)]
    biggest = max(sum(r.size for r in rows if docs[r.doc_id] == t) for t in set(docs.values()))
    assert max(load) - min(load) <= 2 * biggest


def test_a_hot_group_is_numbered_in_parts(make):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = s.shard(make(rows), part_rows=50).collect()
    check(got, {})
    assert len({r.shard for r in got if r.doc_id % 3}) == 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, s.shard(make(rows).repartition(7), part_rows=50).collect()))
    whole = {r.doc_id: r.shard for r in s.shard(make(rows)).collect()}
    assert whole == {r.doc_id: r.shard for r in got}


def test_a_part_grows_with_the_rows_only_beyond_the_most_parts(make, monkeypatch):
    monkeypatch.setattr(s, "MOST_PARTS", 4)
    got = s.shard(make([(i, "same text") for i in range(1000)]), part_rows=10).collect()
    check(got, {})
    assert len({r.shard for r in got}) == 1


def test_odd_rows(odd, none):
    got = s.shard(odd).collect()
    check(got, {})
    assert len(got) == 11 and len({r.shard for r in got if r.size == 8}) == 1 and all(r.text_crc32 == 0 for r in got if r.size == 8)
    assert s.shard(none).count() == 0
