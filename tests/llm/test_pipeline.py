import random

import corpus_pipeline as p
from pyspark.sql import functions as F


def test_stages_each_work_on_what_the_one_before_kept(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, small)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.select("doc_id").distinct().join(kept.select("doc_id"), "doc_id", "left_anti").count() == 0
        kept = out
    last = p.STAGES[-1][1](spark, kept, small)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in kept.collect())
    assert sorted(map(tuple, p.run(spark, small).collect())) == sorted(map(tuple, last.collect()))


def test_planted_cases(spark, make, tmp_path):
    rnd = random.Random(1)
    stock = ["the", "house", "of", "and", "that", "was", "with", "king", "queen", "over", "there", "garden", "river", "stone", "water", "light", "again", "never", "always", "under"]
    some = lambda n: [rnd.choice(stock) + rnd.choice(["", "s", "ed", "er"]) for _ in range(n)]
    passage = some(25)
    rows, clean = [], set()
    for i in range(120):
        words = some(150)
        rows.append((i, " ".join(words)))
        clean.add(i)
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(words)))
            rows.append((2000 + i, " ".join([*words[:70], "changed", *words[71:]])))
        if i % 10 == 5:
            rows[-1] = (i, " ".join(words[:60] + passage + words[60:]))
            clean.discard(i)
    rows += [(5000, None), (5001, "!!! 123"), (5002, "")]
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make(rows)
    for name, stage in p.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in docs.collect()} == clean
    mixed = p.mixing(spark, docs, str(tmp_path))
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_empty_tables_and_clashing_columns(spark, make, odd, none, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
    clean = make([(100 + i, f"the house of the king and the queen number {i} " + " ".join(f"word{i * 7 + k}" for k in range(30))) for i in range(40)])
    docs = clean.join(odd.limit(1).drop("doc_id", "text", "lang", "source", "n_chars")).unionByName(odd)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":  # one of each group stays: of the equal rows of 8 and of 1, and of 5 and 6
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids)) and len({1, 8} & set(ids)) <= 1 and len({5, 6} & set(ids)) <= 1
    last = p.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count()


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
