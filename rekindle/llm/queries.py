"""Registered queries of this package, and their SQL where SQL can express them."""

from rekindle.llm import chat, fingerprints, language, lexical, nearest, packing, periods, pieces, repeats, secrets, similar, toxicity, urls

QUERIES = {
    f.__name__: f
    for f in (
        pieces.op1_sentencepiece, repeats.op2_repeats, chat.op3_chat, nearest.op4_nearest, fingerprints.op5_fingerprints, language.op6_language, similar.op7_jaccard, secrets.op8_secrets,
        urls.op9_urls, packing.op10_packing, toxicity.op11_toxicity, periods.op12_periods, lexical.op13_search,
    )
}
STATEMENTS = {"op3_chat": chat.SQL, "op4_nearest": nearest.SQL, "op7_jaccard": similar.SQL, "op9_urls": urls.SQL, "op13_search": lexical.SQL}
