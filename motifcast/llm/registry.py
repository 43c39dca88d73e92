"""Queries of the training-data operators, and the same in SQL where SQL can express it."""

from __future__ import annotations

from motifcast.llm import chat, collocations, decontam, fingerprint, importance, language, linededup, neardup, packing, secrets, subwords, toxicity, urls

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontam": decontam.op4_decontam,
    "op5_chat": chat.op5_chat,
    "op6_minhash": neardup.op6_minhash,
    "op7_linededup": linededup.op7_linededup,
    "op8_secrets": secrets.op8_secrets,
    "op9_language": language.op9_language,
    "op10_urls": urls.op10_urls,
    "op11_collocations": collocations.op11_collocations,
    "op12_subwords": subwords.op12_subwords,
    "op13_importance": importance.op13_importance,
}
ORACLE_SQL = {"op5_chat": chat.ORACLE, "op6_minhash": neardup.ORACLE, "op7_linededup": linededup.ORACLE, "op10_urls": urls.ORACLE, "op11_collocations": collocations.ORACLE}
