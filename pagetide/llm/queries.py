"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pagetide.llm import bpe, divergence, exact_dedup, filter_audit, fingerprints, html_extract, lm_scoring, mixing, quality, simhash, substring_dedup, token_counts, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_quality": quality.op2_quality,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_simhash": simhash.op4_simhash,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_html": html_extract.op9_html,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_lm_scoring": lm_scoring.op11_lm_scoring,
    "op12_divergence": divergence.op12_divergence,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
