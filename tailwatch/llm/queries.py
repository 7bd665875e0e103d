"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, lm, mixing, near_dup, pieces, quality, secrets, token_counts, topk, warc

QUERIES = {
    "op7_lm": lm.op7_lm,
    "op1_token_counts": token_counts.op1_token_counts,
    "op6_topk": topk.op6_topk,
    "op2_pieces": pieces.op2_pieces,
    "op3_warc": warc.op3_warc,
    "op9_chat": chat.op9_chat,
    "op8_secrets": secrets.op8_secrets,
    "op5_quality": quality.op5_quality,
    "op4_near_dup": near_dup.op4_near_dup,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op6_topk": topk.oracle(),
    "op3_warc": warc.oracle(),
    "op9_chat": chat.oracle(),
    "op4_near_dup": near_dup.oracle(),
    "op10_mixing": mixing.oracle(),
}
