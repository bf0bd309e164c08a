"""The registered queries of this folder's operators."""

from __future__ import annotations

from tripweave.llm import chat, decontam, importance, mixing, pages, quality, repair, secretscan, shards, simhash, tokenfiles, topk, toxicity

QUERIES = {
    "op1_shards": shards.op1,
    "op2_simhash": simhash.op2,
    "op3_topk": topk.op3,
    "op4_html_text": pages.op4,
    "op5_toxicity": toxicity.op5,
    "op6_decontamination": decontam.op6,
    "op7_mixing": mixing.op7,
    "op8_secrets": secretscan.op8,
    "op9_chat": chat.op9,
    "op10_token_files": tokenfiles.op10,
    "op11_resampling": importance.op11,
    "op12_quality": quality.op12,
    "op13_structure_repair": repair.op13,
}
