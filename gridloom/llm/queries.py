"""The queries of this subpackage, each applying one operator to its whole table."""

from gridloom.llm.bpe import op7_bpe
from gridloom.llm.chat import ORACLE_OP9, op9_chat_formatting
from gridloom.llm.mixing import ORACLE_OP2, op2_mixing
from gridloom.llm.quality_model import op5_quality_classifier
from gridloom.llm.quality_rules import ORACLE_OP3, op3_quality_rules
from gridloom.llm.simhash import op4_simhash_near_dedup
from gridloom.llm.token_counts import op8_token_counts
from gridloom.llm.toxicity import op10_toxicity
from gridloom.llm.urls import op1_url_filters
from gridloom.llm.vectors import ORACLE_OP6, op6_exact_top_k

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_bpe": op7_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {"op2_mixing": ORACLE_OP2, "op3_quality_rules": ORACLE_OP3, "op6_exact_top_k": ORACLE_OP6, "op9_chat_formatting": ORACLE_OP9}
