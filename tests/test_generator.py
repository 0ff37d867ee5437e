import pytest

from gaugemill.operators import checks, stats
from gaugemill.sources import generator as g


def test_rows_do_not_depend_on_partitions(spark):
    a, b = g.generate(spark, 5000, seed=3, partitions=1), g.generate(spark, 5000, seed=3, partitions=7)
    assert checks.difference(a, b).count() == 0
    assert checks.difference(a, g.generate(spark, 5000, seed=4)).count() > 0


def test_distribution(spark):
    dim = g.stations(spark, 20)
    rows = stats.station_stats(g.generate(spark, 40_000, dimension=dim)).join(dim.withColumnRenamed("mean", "centre"), stats.F.col("station") == stats.F.col("name")).collect()
    assert len(rows) == 20 and sum(r.c for r in rows) == 40_000
    assert all(1700 < r.c < 2300 and abs(r.mean / 10 - r.centre) < 1.2 for r in rows)


def test_source_is_deterministic(spark):
    spark.dataSource.register(g.MeasurementSource)
    read = lambda: spark.read.format("measurements").option("rows", "1_000_500").option("seed", "7").option("stations", "50").load()
    assert read().rdd.getNumPartitions() == 2
    a, b = (sorted(map(tuple, stats.station_stats(read()).collect())) for _ in range(2))
    assert a == b and sum(r[5] for r in a) == 1_000_500


def test_both_sources_give_the_same_rows(spark):
    spark.dataSource.register(g.MeasurementSource)
    read = spark.read.format("measurements").option("rows", "30_000").load()
    assert checks.difference(read, g.generate(spark, 30_000)).count() == 0


def test_stations_by_rule(spark):
    rows = g.stations(spark).collect()
    sizes = [len(r.name.encode()) for r in rows]
    assert len({r.name for r in rows}) == 413 and min(sizes) <= 4 and max(sizes) >= 18 and any(not r.name.isascii() for r in rows)
    assert g.station_faults(g.stations(spark)).count() == 0 and len({g.station_name(i) for i in range(3000)}) == 3000


def test_stations_from_a_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Qörn;5.7\nAvel;18.0\n")
    assert [tuple(r) for r in g.stations(spark, path=str(tmp_path / "s.txt")).orderBy("number").collect()] == [(0, "Avel", 18.0), (1, "Qörn", 5.7)]


@pytest.mark.parametrize("line,fault", [("Avel;100.5", "bad_mean"), ("Avel;x", "bad_mean"), (";1.0", "bad_name"), ("é" * 51 + ";1.0", "bad_name"), ("Qörn;2.0", "repeated_name")])
def test_faults_of_stations_are_named(spark, tmp_path, line, fault):
    (tmp_path / "s.txt").write_text(f"Qörn;5.7\n{line}\n")
    with pytest.raises(ValueError, match=fault):
        g.stations(spark, path=str(tmp_path / "s.txt"))


def test_stride_sample(spark):
    df = spark.range(10)
    assert sorted(r.id for r in g.stride_sample(df, "id", 4).collect()) == [0, 2, 5, 7]
    assert g.stride_sample(df, "id", 0).count() == g.stride_sample(df, "id", 11).count() == 10
