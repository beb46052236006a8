"""The operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from headerloom.llm import chat, decontam, langid, lexical, licenses, media, mixing, simhash, store, tokens, toxicity, urls, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_licenses": licenses.op2_licenses,
    "op3_language": langid.op3_language,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_chat": chat.op5_chat,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_simhash": simhash.op7_simhash,
    "op8_media": media.op8_media,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_store": store.op10_token_store,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_url_filter": urls.op12_url_filter,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {"op2_licenses": licenses.oracle(), "op11_lexical_search": lexical.oracle(), "op12_url_filter": urls.oracle()}
