"""The operators' queries over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tallyguard.llm import (
    bpe, exact_dedup, license_scan, maxent_lm, merkle_manifest, near_dedup, packing, quality_gam, quality_rules, secret_scan, suffix_dedup, token_alignment, url_filter,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_maxent_lm": maxent_lm.op4_maxent_lm,
    "op5_bpe": bpe.op5_bpe,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_quality_gam": quality_gam.op13_quality_gam,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_license_scan": license_scan.OP3_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
}
