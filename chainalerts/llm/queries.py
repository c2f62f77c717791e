"""The operators as queries (spark, sf_dir) -> DataFrame, and their SQL where it can say it."""

from __future__ import annotations

from chainalerts.llm import (
    circulant_minhash, filter_audit, fm_index, host_rules, language_crf, line_runs, packing,
    pairwise_quality, prefix_free, secrets, site_style_tree, url_rules, vector_codes,
)

QUERIES = {
    "op1_site_style_tree": site_style_tree.op1_site_style_tree,
    "op2_line_runs": line_runs.op2_line_runs,
    "op3_language_crf": language_crf.op3_language_crf,
    "op4_binary_packing": packing.op4_binary_packing,
    "op5_fm_decontamination": fm_index.op5_fm_decontamination,
    "op6_host_quality": host_rules.op6_host_quality,
    "op7_prefix_free": prefix_free.op7_prefix_free,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_circulant_minhash": circulant_minhash.op9_circulant_minhash,
    "op10_url_rules": url_rules.op10_url_rules,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_pairwise_quality": pairwise_quality.op13_pairwise_quality,
}
ORACLES = {
    "op2_line_runs": line_runs.ORACLE,
    "op6_host_quality": host_rules.ORACLE,
    "op10_url_rules": url_rules.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
