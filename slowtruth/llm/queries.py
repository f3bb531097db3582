"""The registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from slowtruth.llm import chat, decontam, langid, lines, mix, neardup, phrases, quality, repair, shard, suffix, tokens, windows

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_sharding": shard.op3_sharding,
    "op4_mixing": mix.op4_mixing,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_language_id": langid.op6_language_id,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_minhash_dedup": neardup.op8_minhash_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_substring_dedup": windows.op12_substring_dedup,
    "op13_phrase_mining": phrases.op13_phrase_mining,
}
#: The others cannot be said in SQL; tests hold them against brute force.
SQL = {
    "op1_line_dedup": lines.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op4_mixing": mix.OP4_SQL,
    "op5_token_counts": tokens.OP5_SQL,
    "op8_minhash_dedup": neardup.OP8_SQL,
    "op10_decontamination": decontam.OP10_SQL,
    "op11_structure_repair": repair.OP11_SQL,
    "op12_substring_dedup": windows.OP12_SQL,
    "op13_phrase_mining": phrases.OP13_SQL,
}
