"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import align, chat, compression, decontaminate, exact_dedup, html_text, merkle, minmax, ngram_join, packing, token_files, toxicity, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_chat_rotation": chat.op3_chat_rotation,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_files": token_files.op5_token_files,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_html_text": html_text.op7_html_text,
    "op8_quality": compression.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_minmax_dedup": minmax.op11_minmax_dedup,
    "op12_token_alignment": align.op12_token_alignment,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_ngram_join": ngram_join.SQL,
    "op2_url_filter": url_filter.SQL,
    "op3_chat_rotation": chat.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op11_minmax_dedup": minmax.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
