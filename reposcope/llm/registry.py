"""Queries of the text operators and the SQL that states the same result."""

from __future__ import annotations

import corpus_pipeline
from reposcope.llm import bpe, chat_format, decontamination, exact_dedup, filter_audit, line_dedup, minhash_dedup, quality, secrets, sharding, substring_dedup, token_alignment, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_minhash_near_dedup": minhash_dedup.op8_minhash_near_dedup,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_chat_formatting": chat_format.op10_chat_formatting,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_sharding": sharding.op12_sharding,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_benchmark_decontamination": decontamination.OP6_SQL,
    "op8_minhash_near_dedup": minhash_dedup.OP8_SQL,
    "op10_chat_formatting": chat_format.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_sharding": sharding.OP12_SQL,
}
