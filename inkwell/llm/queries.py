"""Registered queries of the corpus operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from inkwell.llm import bpe, cascade, decontaminate, fixity, hashing_ann, langid, minhash, pii, quality, suffixes

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_near_duplicates": minhash.op2_near_duplicates,
    "op3_url_filter": cascade.op3_url_filter,
    "op4_fixity_audit": fixity.op4_fixity_audit,
    "op5_pseudonyms": pii.op5_pseudonyms,
    "op6_nearest": hashing_ann.op6_nearest,
    "op7_quality": quality.op7_quality,
    "op8_leaks": decontaminate.op8_leaks,
    "op9_repeated_passages": suffixes.op9_repeated_passages,
    "op10_language_id": langid.op10_language_id,
}

ORACLE_SQL = {
    "op3_url_filter": cascade.OP3_SQL,
    "op4_fixity_audit": fixity.OP4_SQL,
    "op2_near_duplicates": minhash.OP2_SQL,
    "op9_repeated_passages": suffixes.OP9_SQL,
}
