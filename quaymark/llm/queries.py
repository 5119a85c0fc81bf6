"""The registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, language, lexical, packing, pii, pipeline, quality, replies, simhash, suffix, toxicity, turns, vectors, warc

QUERIES = {
    "op1_pii": pii.query,
    "op2_decontamination": decontam.query,
    "op3_warc_transactions": warc.query,
    "op4_simhash": simhash.query,
    "op5_suffix_dedup": suffix.query,
    "op6_quality": quality.query,
    "op7_packing": packing.query,
    "op8_language": language.query,
    "op9_toxicity": toxicity.query,
    "op10_embeddings": vectors.query,
    "op11_lexical": lexical.query,
    "op12_conversation_repair": turns.query,
    "op13_chat_formatting": replies.query,
    "pipeline": pipeline.run,
}
ORACLE = {"op2_decontamination": decontam.ORACLE, "op3_warc_transactions": warc.ORACLE, "op5_suffix_dedup": suffix.ORACLE, "op11_lexical": lexical.ORACLE, "op13_chat_formatting": replies.ORACLE}
