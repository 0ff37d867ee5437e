import math

from pyspark.sql import functions as F

from gaugemill.functions import fixedpoint as fp


def text(t):
    return f"{'-' if t < 0 else ''}{abs(t) // 10}.{abs(t) % 10}"


def test_every_legal_value_is_parsed_and_printed(spark):
    rows = [(text(t), t) for t in range(-999, 1000)] + [("-0.0", 0)]
    df = spark.createDataFrame(rows, "v string, t int")
    got = df.select("v", "t", fp.parse_tenths(F.col("v")).alias("p"), fp.format_tenths(F.col("t")).alias("f")).collect()
    assert all(r.p == r.t and (r.f == r.v or r.v == "-0.0") for r in got)


def test_other_values_are_null(spark):
    bad = ["", "1", "1.23", "100.0", "+1.0", "1e1", "inf", " 1.0", "1.0 ", "--1.0", ".5", "1.", "1,0", "1.0\n"]
    df = spark.createDataFrame([(b,) for b in bad], "v string")
    assert all(r[0] is None for r in df.select(fp.parse_tenths(F.col("v"))).collect())


def test_mean_over_a_sweep(spark):
    counts = spark.createDataFrame([(c,) for c in (1, 2, 3, 7, 10, 99, 1000, 999_983)], "c long")
    df = spark.range(-5000, 5001).crossJoin(counts).select("id", "c", fp.mean_tenths(F.col("id"), F.col("c")).alias("m"))
    assert all(r.m == (2 * r.id + r.c) // (2 * r.c) for r in df.collect())


def test_ties_go_up_and_zero_has_no_sign(spark):
    cases = [(5, 10, 1), (-5, 10, 0), (15, 10, 2), (-15, 10, -1), (-25, 10, -2), (14, 10, 1), (16, 10, 2), (-14, 10, -1), (-16, 10, -2), (-4, 10, 0)]
    df = spark.createDataFrame(cases, "s long, c long, m long")
    assert all(r.m == r.got for r in df.select("m", fp.mean_tenths(F.col("s"), F.col("c")).alias("got")).collect())
    shown = {-999: "-99.9", 999: "99.9", -1: "-0.1", 1: "0.1", 180: "18.0", -69: "-6.9", 0: "0.0"}
    df = spark.createDataFrame(list(shown.items()), "t long, f string")
    assert all(r.f == r.got for r in df.select("f", fp.format_tenths(F.col("t")).alias("got")).collect())


def test_division_rounds_as_named(spark):
    df = spark.range(-20, 21).select("id", fp.floor_div(F.col("id"), F.lit(7)).alias("down"), fp.ceil_div(F.col("id"), F.lit(7)).alias("up"), fp.whole_div(F.col("id"), F.lit(7)).alias("cut"))
    assert all((r.down, r.up, r.cut) == (r.id // 7, -(-r.id // 7), int(r.id / 7)) for r in df.collect())


def test_doubles(spark):
    df = spark.createDataFrame([(-0.04,), (0.05,), (-0.05,), (99.96,), (-120.0,)], "v double")
    got = df.select("v", fp.round1(F.col("v")).alias("r"), fp.clamp_tenths(fp.quantise_tenths(F.col("v"))).alias("q")).collect()
    for r in got:
        assert r.r == math.floor(r.v * 10 + 0.5) / 10 and math.copysign(1, r.r) == 1 or r.r < 0
        assert r.q == max(-999, min(999, math.floor(r.v * 10 + 0.5)))


def test_names(spark):
    names = {"a": True, "": False, "x" * 100: True, "x" * 101: False, "é" * 50: True, "é" * 51: False, "a;b": False, "a\nb": False, "a\0b": True}
    df = spark.createDataFrame(list(names.items()), "n string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", fp.valid_name(F.col("n")).alias("got")).collect())
