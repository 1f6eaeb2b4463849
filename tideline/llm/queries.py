"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tideline.llm import decontaminate, exact_dedup, hard_negatives, html_extract, jaccard_join, line_dedup, merkle, pii, quality, secret_scan, sentence_pieces, suffix_tree_lm, token_blocks

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_blocks": token_blocks.op2_token_blocks,
    "op3_sentence_pieces": sentence_pieces.op3_sentence_pieces,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality": quality.op8_quality,
    "op9_suffix_tree_lm": suffix_tree_lm.op9_suffix_tree_lm,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_pii": pii.op12_pii,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_pii": pii.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
