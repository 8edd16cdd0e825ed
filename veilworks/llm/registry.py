"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from veilworks.llm import ann, bpe, chat, divergence, fingerprint, html, langid, minhash, mixing, search, sharding, suffixes, toxicity


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (langid.op1_word_backoff_language, ann.op2_anisotropic_neighbours, bpe.op3_byte_bpe, mixing.op4_temperature_mix, minhash.op5_min_max_near_duplicates, html.op6_wrapper_extraction, fingerprint.op7_bottom_k_fingerprints, chat.op8_role_repair, sharding.op9_feistel_shards, toxicity.op10_crf_toxicity, divergence.op11_source_divergence, suffixes.op12_prefix_free_parsing, search.op13_threshold_search)}


def oracle_sql() -> dict[str, str]:
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {"op2_anisotropic_neighbours": ann.OP2_SQL, "op4_temperature_mix": mixing.OP4_SQL, "op5_min_max_near_duplicates": minhash.OP5_SQL, "op11_source_divergence": divergence.OP11_SQL, "op12_prefix_free_parsing": suffixes.OP12_SQL, "op13_threshold_search": search.OP13_SQL}
