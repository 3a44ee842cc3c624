"""Registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from tessera.llm.bpe import op1
from tessera.llm.classifier import op4
from tessera.llm.counts import op8
from tessera.llm.jaccard import OP5_SQL, op5
from tessera.llm.langid import op2
from tessera.llm.mixing import OP10_SQL, op10
from tessera.llm.rules import op3
from tessera.llm.tokenio import op6
from tessera.llm.topk import OP9_SQL, op9
from tessera.llm.urls import op7

QUERIES = {
    "op1_bpe_chunks": op1,
    "op2_language_id": op2,
    "op3_quality_rules": op3,
    "op4_quality_classifier": op4,
    "op5_jaccard_join": op5,
    "op6_token_files": op6,
    "op7_url_filters": op7,
    "op8_token_counts": op8,
    "op9_top_k": op9,
    "op10_mixing": op10,
}

ORACLE_SQL: dict[str, str] = {"op5_jaccard_join": OP5_SQL, "op9_top_k": OP9_SQL, "op10_mixing": OP10_SQL}
