"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from seedgrow.llm import bpe, embedding_dedup, fracminhash, hard_negatives, html_wrappers, jaccard_join, langid, licenses, mixing, pii, pitman_yor, runs, sharding

QUERIES = {
    "op1_html": html_wrappers.op1_html,
    "op2_mix": mixing.op2_mix,
    "op3_shard": sharding.op3_shard,
    "op4_jaccard": jaccard_join.op4_jaccard,
    "op5_embeddings": embedding_dedup.op5_embeddings,
    "op6_license": licenses.op6_license,
    "op7_langid": langid.op7_langid,
    "op8_fingerprint": fracminhash.op8_fingerprint,
    "op9_pii": pii.op9_pii,
    "op10_bpe": bpe.op10_bpe,
    "op11_pitman_yor": pitman_yor.op11_pitman_yor,
    "op12_negatives": hard_negatives.op12_negatives,
    "op13_runs": runs.op13_runs,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix": mixing.op2_sql(),
        "op3_shard": sharding.op3_sql(),
        "op8_fingerprint": fracminhash.op8_sql(),
        "op12_negatives": hard_negatives.op12_sql(),
    }
