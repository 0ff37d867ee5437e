"""Ids beyond 2 ** 53, negative and missing ones in one batch come back as they were, from every operator."""

import pytest

from gaugemill.llm import decontamination, lines, mixing, sharding, simhash, suffixes, toxicity

IDS = [2**53 + 1, 2**53 + 3, None, -(2**62) - 1, 0]


@pytest.fixture(scope="module")
def docs(make):
    return make([(i, f"alpha beta gamma {k}", "en", "a") for k, i in enumerate(IDS)])


@pytest.mark.parametrize("name", ["lines", "suffixes", "simhash", "sharding", "toxicity", "mixing", "decontamination", "similar"])
def test_ids_are_exact(spark, docs, name):
    run = {
        "lines": lambda: lines.deduplicated(docs),
        "suffixes": lambda: suffixes.deduplicated(docs),
        "simhash": lambda: simhash.near_duplicates(docs),
        "sharding": lambda: sharding.shard(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(0, 1)], "doc_id long, toxic int"))),
        "mixing": lambda: mixing.mix(docs),
        "decontamination": lambda: decontamination.decontaminate(docs, spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")),
        "similar": lambda: simhash.similar_documents(docs),
    }[name]
    assert sorted((r.doc_id for r in run().collect()), key=str) == sorted(IDS, key=str)
