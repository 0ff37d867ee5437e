"""Queries of the pipeline operators, and their SQL where SQL can express them."""

from __future__ import annotations

from gaugemill.llm.decontamination import OP10_SQL, op10_decontamination
from gaugemill.llm.language import op1_language
from gaugemill.llm.lines import OP3_SQL, op3_lines
from gaugemill.llm.mixing import op9_mixing
from gaugemill.llm.sharding import op6_sharding
from gaugemill.llm.simhash import op5_simhash
from gaugemill.llm.suffixes import OP4_SQL, op4_suffixes
from gaugemill.llm.topk import OP8_SQL, op8_topk
from gaugemill.llm.toxicity import op7_toxicity
from gaugemill.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_language": op1_language,
    "op2_warc": op2_warc,
    "op3_lines": op3_lines,
    "op4_suffixes": op4_suffixes,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL = {
    "op2_warc": OP2_SQL,
    "op3_lines": OP3_SQL,
    "op4_suffixes": OP4_SQL,
    "op8_topk": OP8_SQL,
    "op10_decontamination": OP10_SQL,
}
