"""Queries of the operators here, for the registry, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, divergence, heap_lloyd, hnsw, licenses, mixing, ngram_join, ordinal, quality_rules, secrets, sharding, telephony, toxicity


def queries():
    return {
        "op1_mixing": mixing.query,
        "op2_ngram_join": ngram_join.query,
        "op3_licenses": licenses.query,
        "op4_hnsw": hnsw.query,
        "op5_toxicity": toxicity.query,
        "op6_bpe": bpe.query,
        "op7_secrets": secrets.query,
        "op8_hilbert_shards": sharding.query,
        "op9_ordinal_quality": ordinal.query,
        "op10_quality_rules": quality_rules.query,
        "op11_heap_lloyd": heap_lloyd.query,
        "op12_divergence": divergence.query,
        "op13_telephony": telephony.query,
    }


def oracle_sql():
    return {"op1_mixing": mixing.SQL, "op2_ngram_join": ngram_join.SQL, "op10_quality_rules": quality_rules.SQL, "op11_heap_lloyd": heap_lloyd.SQL, "op12_divergence": divergence.SQL}
