import random

from gaugemill.llm import lines as ln


def plain(docs, run=4, words=50):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        x, gone = text.split("\n"), set()
        for i in range(len(x)):
            w = ()
            while len(w) < run and sum(len(y.split()) for y in w) < words and i + len(w) < len(x):
                w += (x[i + len(w)],)
            if len(w) < run and sum(len(y.split()) for y in w) < words:
                break
            if w in seen:
                gone.update(range(i, i + len(w)))
            seen.add(w)
        out[doc_id] = ("\n".join(t for i, t in enumerate(x) if i not in gone), len(x), len(gone))
    return out


def test_equals_brute_force(make):
    rnd = random.Random(1)
    docs = [(i, "\n".join(rnd.choice("abc") * rnd.randrange(3) for _ in range(rnd.randrange(1, 40)))) for i in range(60)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in ln.deduplicated(make(docs)).collect()}
    assert got == plain(docs)


def test_long_lines_equal_brute_force(make):
    rnd = random.Random(2)
    lines = [" ".join(rnd.choice("uvwxyz") for _ in range(n)) for n in (0, 1, 9, 17, 24, 26, 49, 50, 51, 120)]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 9)))) for i in range(80)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in ln.deduplicated(make(docs)).collect()}
    assert got == plain(docs)


def test_one_long_line_goes_and_a_short_one_stays(make):
    long, short = " ".join(["word"] * 50), " ".join(["word"] * 49)
    got = {r.doc_id: r.text for r in ln.deduplicated(make([(1, f"{long}\na"), (2, f"b\n{long}"), (3, short), (4, short)])).collect()}
    assert got == {1: f"{long}\na", 2: "b", 3: short, 4: short}


def test_runs_are_maximal(make):
    a = [f"line {i}" for i in range(12)]
    docs = [(1, "\n".join(a)), (2, "\n".join(["x", *a[2:9], "y"])), (3, "\n".join(a[:3]))]
    got = [tuple(r) for r in ln.repeated_runs(ln.line_hashes(make(docs))).select("id", "start", "n_lines", "first_id", "first_start").collect()]
    assert got == [(2, 1, 7, 1, 2)]


def test_odd_rows(odd, none):
    got = ln.deduplicated(odd).collect()
    assert len(got) == 11
    nine = next(r for r in got if r.doc_id == 9)
    assert (nine.text, nine.n_lines, nine.n_removed) == ("a\nb\nc\nd\ne", 10, 5)
    assert [(r.text, r.n_lines) for r in got if r.doc_id == 2] == [(None, 0)] and [r.n_lines for r in got if r.doc_id == 4] == [1]
    assert ln.deduplicated(none).count() == 0


def test_equal_rows_keep_what_the_first_keeps(make):
    got = ln.deduplicated(make([(1, "a\nb\nc\nd")] * 2 + [(2, "a\nb\nc\nd")])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "")]
