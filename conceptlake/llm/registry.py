"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import decontamination, fingerprints, html_text, language, licences, line_dedup, lm_scoring, minhash, mixing, ngram_join, periodic_runs, toxicity, vector_codes

QUERIES = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_language_id": language.op2_language_id,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scans": licences.op5_license_scans,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
    "op9_mixing_sources": mixing.op9_mixing_sources,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_minhash_near_dedup": minhash.op12_minhash_near_dedup,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op8_ngram_jaccard_join": ngram_join.OP8_SQL,
    "op9_mixing_sources": mixing.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_minhash_near_dedup": minhash.OP12_SQL,
}
