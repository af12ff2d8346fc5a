"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from listenflow.llm.bpe_fst import op9_query
from listenflow.llm.conversation_repair import op13_query
from listenflow.llm.exact_dedup import OP5_SQL, op5_query
from listenflow.llm.jaccard_join import OP7_SQL, op7_query
from listenflow.llm.language_id import op12_query
from listenflow.llm.packing import op6_query
from listenflow.llm.pii import op1_query
from listenflow.llm.quality_cnn import op4_query
from listenflow.llm.quality_rules import op3_query
from listenflow.llm.secret_scan import op8_query
from listenflow.llm.spelling_variants import OP11_SQL, op11_query
from listenflow.llm.substring_dedup import OP2_SQL, op2_query
from listenflow.llm.toxicity import op10_query

QUERIES = {
    "op1_pii": op1_query,
    "op2_substring_dedup": op2_query,
    "op3_quality_rules": op3_query,
    "op4_quality_cnn": op4_query,
    "op5_exact_dedup": op5_query,
    "op6_packing": op6_query,
    "op7_jaccard_join": op7_query,
    "op8_secret_scan": op8_query,
    "op9_bpe": op9_query,
    "op10_toxicity": op10_query,
    "op11_spelling_variants": op11_query,
    "op12_language_id": op12_query,
    "op13_conversation_repair": op13_query,
}

ORACLE_SQL = {
    "op2_substring_dedup": OP2_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op11_spelling_variants": OP11_SQL,
}
