"""The registered queries of this package and their SQL."""

from palimpsest.llm import bpe, jaccard, lm, mixing, pii, quality, substrings, topk, toxicity, urls

QUERIES = {
    "op1_quality": quality.op1,
    "op2_topk": topk.op2,
    "op3_substrings": substrings.op3,
    "op4_jaccard": jaccard.op4,
    "op5_bpe": bpe.op5,
    "op6_toxicity": toxicity.op6,
    "op7_lm": lm.op7,
    "op8_pii": pii.op8,
    "op9_mixing": mixing.op9,
    "op10_urls": urls.op10,
}

SQL = {
    "op1_quality": quality.SQL,
    "op2_topk": topk.SQL,
    "op9_mixing": mixing.SQL,
    "op10_urls": urls.SQL,
}
