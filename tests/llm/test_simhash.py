import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from gaugemill.llm import simhash as s
from gaugemill.llm.components import roots


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """doc_id -> smallest doc_id over links of at most 3 bits."""
    parent = list(range(len(pairs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                parent[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(pairs):
        groups.setdefault(top(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = plain_components(fps)
    got = s.op5_simhash(spark, small).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in fps}
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_of_random_fingerprints_with_and_without_divided_shards(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    values = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(6)}
    values |= {(0xFFFF << 48) | rnd.getrandbits(40) for _ in range(200)}
    values = sorted(values)
    want = plain_components(list(enumerate(values)))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for hot in (4, 10_000):
        found = {(r.node if r.node >= 0 else r.node + (1 << 64)): r.root for r in roots(s.links(df, hot=hot)).collect()}
        groups = {}
        for i, v in enumerate(values):
            groups.setdefault(found.get(v, ("own", v)), set()).add(i)
        other = {}
        for i, c in want.items():
            other.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_tree_finds_all_within_the_radius():
    rnd = random.Random(2)
    tree, values = s.BKTree(), [rnd.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_packed_tree_finds_the_same_pairs():
    rnd = np.random.default_rng(2)
    values = rnd.integers(0, 1 << 14, 400).astype(np.uint64)
    want = {(i, j) for i in range(400) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3}
    for block in (1000, 1 << 19):
        got = [p for i, j in s.PackedBKTree(values).pairs(3, block) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(want) and set(got) == want
    assert {p for i, j in s.close_pairs(values[:40], 3) for p in zip(i.tolist(), j.tolist())} == {(i, j) for i, j in want if i < 40}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 60)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)}


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.fp, r.component_id) for r in s.near_duplicates(odd).collect()]
    assert len(got) == 11
    assert {c for d, f, c in got if f == 0} == {2} and sum(f == 0 for _, f, _ in got) == 4
    assert sum(c == 1 for _, _, c in got) == 4
    assert s.near_duplicates(none).count() == 0 and s.one_of_each(none).count() == 0


def test_one_of_each_group_stays(odd):
    kept = s.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 5, 9]


def test_near_copies_go_and_others_stay(make):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, want = [], set()
    for g in range(30):
        words = [word() for _ in range(200)]
        rows.append((g * 10, " ".join(words)))
        want.add(g * 10)
        for k in range(1, 4):
            copy = list(words)
            for _ in range(3):
                copy[rnd.randrange(200)] = word()
            rows.append((g * 10 + k, " ".join(copy)))
    kept = {r.doc_id for r in s.one_of_each(make(rows)).collect()}
    assert kept == want
    assert {r.doc_id for r in s.one_of_each(make(rows), hot=2).collect()} == want


def test_resemblance():
    sets = [set(range(100)), set(range(20, 120)), set(range(5)), set(range(3, 8)), set(), set(range(1000)), set(range(100, 1100))]
    m = s.sketch_matrix([np.array(sorted(x)[:128], np.uint64).tobytes() for x in sets], 128)
    i, j = np.triu_indices(len(sets))
    got = s.resemblance(m[i], m[j])
    for a, b, x in zip(i, j, got):
        both = sorted(sets[a] | sets[b])[:128]
        assert x == (len(sets[a] & sets[b] & set(both)) / len(both) if both else 1.0)
    assert s.agreeing(m, 0.5)(i, j).tolist() == [x >= 0.5 for x in got]


def test_long_texts_are_linked_by_their_whole_sets(make):
    """Pairs of 1,000 shingles on both sides of 0.8, where a sketch of 128 hashes often errs."""
    rnd = random.Random(4)
    rows, want = [], {}
    for g in range(40):
        words = [f"{rnd.getrandbits(40):x}" for _ in range(1004)]
        more = 245 if g % 2 else 255  # 1000 / 1245 is above 0.8, 1000 / 1255 below
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words, *(f"{rnd.getrandbits(40):x}" for _ in range(more))]))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g if g % 2 else 2 * g + 1}
    assert {r.doc_id: r.component_id for r in s.similar_documents(make(rows)).collect()} == want


def test_exact_links_equal_brute_force():
    rnd = np.random.default_rng(1)
    base = [np.arange(200, dtype=np.uint64) + np.uint64(1000 * g) for g in range(4)]
    sets = [np.unique(np.where(rnd.random(200) < rnd.choice([0.02, 0.1, 0.2]), rnd.integers(1 << 40, 1 << 50, 200).astype(np.uint64), base[k % 4])) for k in range(60)]
    want = [(i, j) for i in range(60) for j in range(i) if np.intersect1d(sets[i], sets[j]).size / np.union1d(sets[i], sets[j]).size >= 0.8]

    def groups(links):
        label = list(range(60))
        for a, b in links:
            label = [label[b] if x == label[a] else x for x in label]
        return sorted(tuple(i for i in range(60) if label[i] == x) for x in set(label))

    for block in (100, 1 << 22):
        assert groups(s.exact_links(sets, list(range(60)), 0.8, block)) == groups(want)


def test_repeated_passages_do_not_part_equal_sets(make):
    rnd = random.Random(6)
    rows = []
    for g in range(40):
        words = [f"{rnd.getrandbits(40):x}" for _ in range(100)]
        page = words[:6]
        rows += [(2 * g, " ".join(words + page)), (2 * g + 1, " ".join(words + page * 40))]
    assert {r.doc_id for r in s.one_of_each(make(rows)).collect()} == {2 * g for g in range(40)}


def test_the_radius_keeps_similar_sets():
    """Sets at a similarity of 0.8, large and small, whose fingerprints must lie within the radius."""
    rnd = np.random.default_rng(3)
    for n in (4, 8, 100, 1000):
        for _ in range(2000):
            x = rnd.integers(0, 1 << 63, n + n // 4, dtype=np.int64).view(np.uint64)
            assert (s.majority(x[:n]) ^ s.majority(x)).bit_count() <= s.WIDE


def test_wide_radius_compares_all():
    values = np.random.default_rng(2).integers(0, 1 << 62, 700).astype(np.uint64)
    got = {p for i, j in s.close_pairs(values, 26) for p in zip(i.tolist(), j.tolist())}
    assert got == {(i, j) for i in range(700) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 26}


def test_similar_sets_are_proposed_through_trees(monkeypatch):
    """Of a small and of a large shard; equal fingerprints are one node of the large one's tree, and its edges leave comparisons out."""
    rnd = np.random.default_rng(8)
    asked, trees, compared = [], [], []
    within, build, count = s.BKTree.within, s.PackedBKTree.__init__, np.bitwise_count
    monkeypatch.setattr(s.BKTree, "within", lambda self, value, radius: asked.append(radius) or within(self, value, radius))
    monkeypatch.setattr(s.PackedBKTree, "__init__", lambda self, values: trees.append(values.size) or build(self, values))
    one = np.uint64(1)
    for n in (20, 100):
        sets = [np.unique(np.append(rnd.integers(1 << 40, 1 << 62, 50 + k % 2).astype(np.uint64), one)) for k in range(n // 2)] * 2
        fp = np.array([s.majority(x) for x in sets], np.uint64)
        found, unsure = s.proposals(fp, np.array([x.size for x in sets]), s.sketch_matrix([x.tobytes() for x in sets], 128), one, list(range(n)), 0.8, s.WIDE, 5)
        assert sorted(map(sorted, found)) == [[k, k + n // 2] for k in range(n // 2)]
        assert not unsure.any()
    assert asked == [s.WIDE] * 20 and trees == [50]
    near = np.where(np.arange(700) % 2, np.uint64(12345), ~np.uint64(12345))
    values = near ^ (one << rnd.integers(0, 64, 700).astype(np.uint64)) ^ (one << rnd.integers(0, 64, 700).astype(np.uint64))
    want = {(i, j) for i in range(700) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= s.WIDE}
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(x.size) or count(x))
    for block in (1000, 1 << 18):
        compared.clear()
        got = [p for i, j in s.joint_pairs(values, s.WIDE, block) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(want) and set(got) == want
        assert sum(compared) < 0.7 * 700 * 700 / 2


def test_large_shards_lose_no_link(make):
    """Texts of one shingle, whose only hash makes a shard, and texts that share just one least hash with the others of a large shard."""
    rows = [(i, " " * i + ("one two three" if i % 2 else "One Two THREE")) for i in range(8)] + [(10 + i, "chant " * (5 + i)) for i in range(8)]
    assert {r.doc_id for r in s.one_of_each(make(rows), hot=2).collect()} == {0, 10}


def test_divided_shards_hold_every_similar_pair(spark):
    rnd = random.Random(7)
    sizes = [0, 1, 1, 4, 5, *(rnd.randrange(1, 2000) for _ in range(100)), *(rnd.randrange(90, 110) for _ in range(40))]
    df = spark.createDataFrame([(i, n, 77) for i, n in enumerate(sizes)], "node long, size int, least_hash long")
    shards = {}
    for r in s.divided(df, 0.8, 8).collect():
        assert r.least_hash == 77
        shards.setdefault(r.shard, set()).add(r.node)
    together = {(a, b) for x in shards.values() for a in x for b in x}
    assert all((a, b) in together for a, m in enumerate(sizes) for b, n in enumerate(sizes) if min(m, n) >= 0.8 * max(m, n))
    assert max(map(len, shards.values())) < 40
