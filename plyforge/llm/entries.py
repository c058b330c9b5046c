"""The queries of this package, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from plyforge.llm import bpe, chat, decontaminate, exact_dedup, filter_audit, idstore, licenses, line_dedup, minhash, pii, substring_dedup, toxicity, whitening

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_chat_format": chat.op3_chat_format,
    "op4_pii": pii.op4_pii,
    "op5_token_store": idstore.op5_token_store,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL = {
    "op1_minhash_near_dedup": minhash.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
