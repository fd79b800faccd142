"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import linededup, lmscore, mixing, pieces, simhash, suffixdedup, topk, toxicity, urls, webp

QUERIES = {
    "op1_linededup": linededup.op1_linededup,
    "op2_lmscore": lmscore.op2_lmscore,
    "op3_topk": topk.op3_topk,
    "op4_pieces": pieces.op4_pieces,
    "op5_urls": urls.op5_urls,
    "op6_simhash": simhash.op6_simhash,
    "op7_webp": webp.op7_webp,
    "op8_suffixdedup": suffixdedup.op8_suffixdedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {"op2_lmscore": lmscore.OP2_SQL, "op3_topk": topk.OP3_SQL, "op5_urls": urls.OP5_SQL, "op8_suffixdedup": suffixdedup.OP8_SQL, "op10_mixing": mixing.OP10_SQL}
