import os
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import checks, phases, report, stats
from gaugemill.sources import measurements as m
from gaugemill.sources import scratch
from gaugemill.streaming.stats import drained, stream_lines, streaming_stats

ALPHABET = "abcxyzABZ 0189-_.,#'\"éßøñЖДя東京☃🙂\t\r"


def names_of(rnd, count, longest=100):
    """Different names of 1 to longest bytes; some are prefixes of others, and some differ only in their last character."""
    out = {"a", "a" * 100, "é" * 50, "a" * 99 + "b"}
    while len(out) < count:
        base = "".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([1, 2, 7, 8, 15, 16, 31, 32, 33, 60])))
        for name in (base, base + "x", base + "y", base[:-1]):
            if 1 <= len(name.encode()) <= longest and name.strip("\r"):
                out.add(name)
    return sorted(out)


def shown(t):
    return f"{'-' if t < 0 else ''}{abs(t) // 10}.{abs(t) % 10}"


def expected(rows):
    """The report of (name, tenths) rows in plain integers."""
    state = defaultdict(list)
    for name, t in rows:
        state[name].append(t)
    parts = [f"{k}={shown(min(v))}/{shown((2 * sum(v) + len(v)) // (2 * len(v)))}/{shown(max(v))}" for k, v in sorted(state.items(), key=lambda x: x[0].encode())]
    return "{" + ", ".join(parts) + "}"


def report_of(spark, path):
    return report.report(stats.station_stats(m.read_measurements(spark, str(path)))).first()[0]


@pytest.mark.parametrize("seed", range(6))
def test_random_files_equal_the_integer_model(spark, tmp_path, seed):
    rnd = random.Random(seed)
    names = names_of(rnd, (1, 8, 200, 3000)[seed % 4])
    rows = [(rnd.choice(names), rnd.choice([rnd.randrange(-999, 1000), 0, -999, 999, rnd.choice([-1, 1, 5, -5])])) for _ in range(6000)]
    line = lambda n, t: f"{n};{'-0.0' if t == 0 and rnd.random() < 0.3 else shown(t)}"
    end = rnd.choice(["\n", "\r\n"])
    body = "".join(line(*r) + end + ("\n" if rnd.random() < 0.01 else "") for r in rows)
    (tmp_path / "in.txt").write_bytes((body if seed % 2 else body.rstrip("\r\n")).encode())
    assert report_of(spark, tmp_path / "in.txt") == expected(rows)


def test_files_and_streams_give_the_same_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"Q;1.0\r\n\r\n\nR;-2.5\nQ\rQ;3.0\r\nQ;9.9")
    batch = stats.station_stats(m.read_measurements(spark, str(tmp_path / "in")))
    stream = drained(streaming_stats(stream_lines(spark, str(tmp_path / "in"))))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect())) and batch.count() == 3


@pytest.mark.parametrize("values,want", [([-1, 0], "-0.1/0.0/0.0"), ([-1], "-0.1/-0.1/-0.1"), ([999, -999], "-99.9/0.0/99.9"), ([31, 32], "3.1/3.2/3.2"), ([-31, -32], "-3.2/-3.1/-3.1")])
def test_rounding_of_means(spark, tmp_path, values, want):
    (tmp_path / "in.txt").write_text("".join(f"K;{shown(v)}\n" for v in values))
    assert report_of(spark, tmp_path / "in.txt") == "{K=" + want + "}"


def test_an_empty_file_gives_an_empty_report(spark, tmp_path):
    (tmp_path / "in.txt").write_text("")
    assert report_of(spark, tmp_path / "in.txt") == "{}"


@pytest.mark.parametrize("split", [1000, 4096, 65536])
@pytest.mark.parametrize("end", ["", "\n"])
def test_every_line_is_read_once_however_files_are_split(spark, tmp_path, split, end):
    names = names_of(random.Random(9), 40, longest=90)
    lines = [f"{names[i % 40]}{i};{i % 100}.{i % 10}" for i in range(3000)]
    (tmp_path / "in.txt").write_bytes(("\n".join(lines) + end).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert sorted(r.value for r in m.read_lines(spark, str(tmp_path / "in.txt")).collect()) == sorted(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_malformed_lines(spark, tmp_path):
    lines = ["", "Abha", ";1.0", "Abha;", "Abha;1", "Abha;1.23", "Abha;100.0", "Abha;+1.0", "Abha;1e1", "Abha;1.0\r", "x" * 101 + ";1.0", '"A;1.0', "#D;4.0", "A\rb;1.0", "ab;cd;1.0"]
    (tmp_path / "in.txt").write_bytes("\n".join(lines).encode())
    read = m.read_lines(spark, str(tmp_path / "in.txt"))
    good, bad = m.split_valid(read)
    assert sorted(r.station for r in good.collect()) == sorted(["Abha", '"A', "#D", "A\rb"])
    assert bad.count() == 10
    assert m.parse(read, m.DROPMALFORMED).count() == 4 and m.parse(read, m.PERMISSIVE).count() == 14
    with pytest.raises(Exception, match="malformed line"):
        m.parse(read).collect()


def test_merging_in_any_split_gives_the_same(spark):
    rnd = random.Random(1)
    rows = [(f"k{rnd.randrange(9)}", rnd.randrange(-999, 1000), rnd.randrange(5), rnd.randrange(3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "station string, tenths int, a int, b int")
    want = sorted(map(tuple, stats.station_stats(df).collect()))
    for by in ("a", "b"):
        merged = stats.with_mean(stats.merge_stats(stats.partial_stats(df, by))).select("station", "mn", "mean", "mx", "s", "c")
        assert sorted(map(tuple, merged.collect())) == want
    parts = [stats.partial_stats(df.where(F.col("a") == i)) for i in range(5)]
    assert sorted(map(tuple, stats.with_mean(stats.merge_stats(*parts)).select("station", "mn", "mean", "mx", "s", "c").collect())) == want


@pytest.mark.parametrize("size", [1, 2, 3, 7, 13, 64, 1000, 100_000])
def test_chunks_cover_every_byte_once(spark, size):
    lines = spark.range(200).select("id", F.concat(F.lit("Station"), F.col("id").cast("string"), F.lit(";1.0")).alias("value"))
    placed = m.with_offsets(lines.repartition(7).withColumns({"part": F.lit(1), "by": F.lit(2)}), "id")
    rows = sorted(map(tuple, m.chunk_bounds(placed, size).collect()))
    text = "".join(f"Station{i};1.0\n" for i in range(200))
    assert rows[0][2] == 0 and rows[-1][3] == len(text) and sum(r[1] for r in rows) == 200
    assert all(a[3] == b[2] for a, b in zip(rows, rows[1:]))
    for chunk, _, first, end in rows:
        assert first == 0 and chunk == 0 or (first - 1) // size == chunk
        assert text[end - 1] == "\n"
    assert m.number_of_chunks(len(text), size) > rows[-1][0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b, c", -15), ("a", 20), ("b, c", 5)], "station string, tenths long")
    m.write_measurements(df, str(tmp_path / "out"), files=1)
    assert sorted(r.value for r in m.read_lines(spark, str(tmp_path / "out")).collect()) == ["a;2.0", "b, c;-1.5", "b, c;0.5"]
    s = stats.station_stats(df)
    text = report.report(s)
    assert text.first()[0] == "{a=2.0/2.0/2.0, b, c=-1.5/-0.5/0.5}"
    assert [r.line for r in report.split_report(text).collect()] == ["a=2.0/2.0/2.0", "b, c=-1.5/-0.5/0.5"]
    report.write_report(s, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 2


def test_large_sums_do_not_overflow(spark):
    df = spark.range(3_000_000).select(F.lit("a").alias("station"), F.lit(999).alias("tenths"))
    assert stats.station_stats(df).first().s == 2_997_000_000


def test_differences_count_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "z")], "n int, row string")
    b = spark.createDataFrame([("x", 1), (None, 2), (None, 2), ("w", 3)], "row string, n int").select("n", "row")
    assert sorted(map(tuple, checks.difference(a, b).collect()), key=str) == sorted([(1, "x", "left"), (1, "x", "left"), (3, "z", "left"), (2, None, "right"), (3, "w", "right")], key=str)


def test_timings(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), rnd.choice([0.5, 1.25, 2.0, rnd.random()])) for _ in range(999)] + [("d", None), ("e", 3.0), ("e", None)]
    df = spark.createDataFrame(rows, "label string, s double")
    plain = {k: [v for x, v in rows if x == k and v is not None] for k in "abcde"}
    for r in stats.timing_summary(df, "label", "s").collect():
        v = plain[r.label]
        assert (r.median, r.least, r.most, r.n) == ((statistics.median(v), min(v), max(v), len(v)) if v else (None, None, None, 0))
    for r in stats.timing_summary_approx(df, "label", "s").where("n > 0").collect():
        v = sorted(plain[r.label])
        assert r.median in v[len(v) // 2 - 1 : len(v) // 2 + 2]


def test_phases_of_past_stages(spark):
    spark.range(0, 1000, 1, 3).groupBy((F.col("id") % 7).alias("k")).count().collect()
    spent = phases.task_times(spark)
    got = phases.phase_report(spent).collect()
    assert got and all(0 <= r.spread <= r.longest and r.tasks >= 1 for r in got)
    assert phases.executor_phases(spent).first().workers == 1


def test_intermediate_files_need_a_shared_folder_and_are_released(spark):
    path = scratch.scratch_path(spark, "x")
    other = path.replace(spark.sparkContext.applicationId, "another-run")
    for p in (path, other):
        spark.range(3).write.parquet(p)
    scratch.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file:")) and os.path.exists(other.removeprefix("file:"))
    scratch.remove(spark, other)

    class Cluster:
        master, getConf, getCheckpointDir = "spark://host:7077", dict, staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Cluster, {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
