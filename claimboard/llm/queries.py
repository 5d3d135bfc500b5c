"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import alignment, decontam, langid, linededup, mixing, ngram_jaccard, pii, ppm, quality, spelling, tokenbin, tokencount, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_source_mix": mixing.op2,
    "op3_language": langid.op3,
    "op4_token_counts": tokencount.op4,
    "op5_toxicity": toxicity.op5,
    "op6_ngram_jaccard": ngram_jaccard.op6,
    "op7_line_dedup": linededup.op7,
    "op8_personal_data": pii.op8,
    "op9_decontaminate": decontam.op9,
    "op10_token_output": tokenbin.op10,
    "op11_spelling": spelling.op11,
    "op12_alignment": alignment.op12,
    "op13_partial_matching": ppm.op13,
}
SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_source_mix": mixing.OP2_SQL,
    "op6_ngram_jaccard": ngram_jaccard.OP6_SQL,
    "op7_line_dedup": linededup.OP7_SQL,
    "op9_decontaminate": decontam.OP9_SQL,
}
