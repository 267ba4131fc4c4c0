"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, fim, jaccard_join, langid, lm_score, mixing, quality, repair, suffix_dedup, toxicity, winnow

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_chat_format": chat.op4_chat_format,
    "op5_langid": langid.op5_langid,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_mix": mixing.op7_mix,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality": quality.op10_quality,
    "op11_repair": repair.op11_repair,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_fingerprints": winnow.op13_fingerprints,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_repair": repair.OP11_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
}
