"""Queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from . import chat, decontamination, embeddings, jaccard, language, mixing, quality, substrings, tokens, toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_jaccard": jaccard.op1_jaccard,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_tokens": tokens.op4_tokens,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_substrings": substrings.op6_substrings,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_language": language.op8_language,
    "op9_chat": chat.op9_chat,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op1_jaccard": jaccard.OP1_SQL,
    "op5_embeddings": embeddings.OP5_SQL,
    "op6_substrings": substrings.OP6_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
