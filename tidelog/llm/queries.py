"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontam, html_text, line_dedup, lm_score, near_dup, pii, quality, sentencepiece, topk, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece.op1_sentencepiece,
    "op2_pii": pii.op2_pii,
    "op3_decontam": decontam.op3_decontam,
    "op4_topk": topk.op4_topk,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_html_text": html_text.op6_html_text,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_warc": warc.op8_warc,
    "op9_quality": quality.op9_quality,
    "op10_lm_score": lm_score.op10_lm_score,
}

ORACLES = {
    "op4_topk": topk.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
}
