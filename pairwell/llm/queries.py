"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pairwell.llm import chat, decontam, hmm, host_rules, langid, line_dedup, mixing, simhash, suffix_dedup, token_counts

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_hidden_markov": hmm.query,
    "op3_poisson_mixing": mixing.query,
    "op4_string_kernels": langid.query,
    "op5_host_rules": host_rules.query,
    "op6_line_dedup": line_dedup.query,
    "op7_chat_templates": chat.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_decontamination": decontam.query,
    "op10_golay_simhash": simhash.query,
}
ORACLE_SQL = {
    "op3_poisson_mixing": mixing.SQL,
    "op5_host_rules": host_rules.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_chat_templates": chat.SQL,
    "op9_decontamination": decontam.SQL,
}
