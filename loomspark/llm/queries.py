"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from loomspark.llm import bpe, exact_dedup, langid, licenses, minhash, mixing, pii, resharding, secrets, topk

QUERIES = {
    "op1_langid": langid.query,
    "op2_topk": topk.query,
    "op3_byte_bpe": bpe.query,
    "op4_licenses": licenses.query,
    "op5_pii": pii.query,
    "op6_reshard": resharding.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_secrets": secrets.query,
    "op9_mix": mixing.query,
    "op10_minhash": minhash.query,
}

ORACLES = {
    "op2_topk": topk.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
}
