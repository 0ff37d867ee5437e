import hashlib
import random

import numpy as np
import pytest

from gaugemill.llm import suffixes as s


def outcome(df):
    return [(r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def texts(seed):
    """Copies, edited copies, shared passages in different surroundings, periodic texts, within and across documents."""
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("abcdeé \n") for _ in range(n))
    passage, base = some(90), some(300)
    out = [base, base, some(10), "", base[:150] + "Q" + base[150:], some(200) + passage + some(50) + passage, passage, "ab" * 100, "abab" * 20 + some(80), "a" * 120, some(250)]
    for _ in range(12):
        out.append(some(rnd.randrange(60)) + passage + some(rnd.randrange(60)))
        cut = rnd.randrange(250)
        out.append(some(30) + base[cut:] + base[: rnd.randrange(200)])
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [2, 1000])
def test_equals_brute_force(make, seed, most):
    rows = texts(seed)
    want = s.brute_force([t.encode() for t in rows], 40)
    got = outcome(s.deduplicated(make(list(enumerate(rows))), length=40, gram=8, most=most))
    assert got == want


def test_query_equals_brute_force(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    want = s.brute_force([(r.text or "").encode() for r in docs])
    got = [(r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(s.op4_suffixes(spark, small).collect())]
    assert got == want


def test_repeats_equals_its_plain_form():
    rnd = random.Random(4)
    for _ in range(20):
        core = bytes(rnd.choice(b"ab") for _ in range(8))
        parts, before, group = [], [], []
        for g in range(3):
            for _ in range(rnd.randrange(1, 9)):
                left = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(12)))
                parts.append(left + core + bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(12))))
                before.append(len(left))
                group.append(g)
        cover = []
        for f in (s.repeats, s.repeats_by_bytes):
            marked = [np.zeros(len(p), bool) for p in parts]
            for i, a, b in zip(*f(parts, np.array(before), np.array(group), 14), strict=True):
                # only strings about the anchor count, as others belong to other anchors
                a, b = int(a) + before[i], int(b) + before[i]
                for x in range(a, b - 13):
                    if x <= before[i] <= x + 14 - 8:
                        marked[i][x : x + 14] = True
            cover.append([m.tolist() for m in marked])
        assert cover[0] == cover[1]


def test_merge_sort_sorts_within_groups():
    rnd = np.random.default_rng(1)
    group = np.sort(rnd.integers(0, 20, 300))
    value = rnd.integers(0, 30, 300)
    order = s.merge_sort(group, lambda i, j: value[i] < value[j])
    assert order.tolist() == np.lexsort((np.arange(300), value, group)).tolist()


def test_long_documents_are_anchored_in_pieces(monkeypatch):
    rnd = random.Random(9)
    text = bytes(rnd.choice(b"abcd") for _ in range(5000))
    whole = list(s.document_anchors([text], 60, 8))
    monkeypatch.setattr(s, "PIECE", 700)
    parts = list(s.document_anchors([text], 60, 8))
    assert [x.tolist() for x in whole[0][1:]] == [x.tolist() for x in parts[0][1:]]


def test_odd_rows(odd, none):
    got = s.deduplicated(odd).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id in (2, 4, 5, 6, 9)}
    assert (by[2].n_bytes, by[4].n_bytes, by[9].n_removed) == (0, 0, 0)
    assert by[5].n_removed == by[5].n_bytes and by[6].n_removed == by[6].n_bytes - 1
    assert s.deduplicated(none).count() == 0


def test_equal_rows_lose_what_they_share(make):
    rows = [(1, "x" * 3 + "abcdefghij" * 6)] * 2 + [(2, "other")]
    got = s.deduplicated(make(rows), length=40, gram=8).collect()
    assert sorted((r.doc_id, r.n_bytes - r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 5)]
