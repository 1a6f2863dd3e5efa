"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, exact_dedup, filling, language, markov, media, mixing, near, pieces, quality, repeats, similar, spelling

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language_id": language.op2_language_id,
    "op3_repeated_strings": repeats.op3_repeated_strings,
    "op4_hmm_scores": markov.op4_hmm_scores,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_ngram_jaccard": similar.op6_ngram_jaccard,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_media_columns": media.op9_media_columns,
    "op10_poisson_mixing": mixing.op10_poisson_mixing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_fill_in_middle": filling.op12_fill_in_middle,
    "op13_near_dedup": near.op13_near_dedup,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_poisson_mixing": mixing.ORACLE_SQL,
    "op12_fill_in_middle": filling.ORACLE_SQL,
    "op13_near_dedup": near.ORACLE_SQL,
}
