import pytest

from gaugemill.llm.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, same, name):
    same(QUERIES[name](spark, small).select(*columns(name)), ORACLE_SQL[name])


def columns(name):
    return {
        "op2_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op3_lines": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
        "op4_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op8_topk": ["query_id", "rank", "vec_id", "score"],
        "op10_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    }[name]
