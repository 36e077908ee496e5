"""The registered text queries and their SQL."""

from __future__ import annotations

from attestra.llm import bpe, hard_negatives, html_text, maxent_lm, packing, pii, quality_rules, secrets, simhash, token_files, topk, url_filters, vector_codes

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_html_text": html_text.op2_html_text,
    "op3_maxent_lm": maxent_lm.op3_maxent_lm,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_pii": pii.op5_pii,
    "op6_bpe": bpe.op6_bpe,
    "op7_packing": packing.op7_packing,
    "op8_topk": topk.op8_topk,
    "op9_secrets": secrets.op9_secrets,
    "op10_simhash": simhash.op10_simhash,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_token_files": token_files.op12_token_files,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op4_url_filters": url_filters.ORACLE,
    "op8_topk": topk.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
