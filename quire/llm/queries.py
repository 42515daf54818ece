"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, minhash, pieces, quality_model, quality_rules, runs, spelling, substring_dedup, suffix_dedup, token_files, url_filters

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_chat": chat.op5_chat,
    "op6_minhash": minhash.op6_minhash,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_runs": runs.op11_runs,
    "op12_pieces": pieces.op12_pieces,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
}
