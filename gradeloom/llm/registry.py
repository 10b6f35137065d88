"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import align, bpe, decontaminate, langid, lm, merkle, minhash, neighbours, pii, quality, secrets, token_files, topk

QUERIES = {
    "op1_quality": quality.query,
    "op2_secrets": secrets.query,
    "op3_minhash": minhash.query,
    "op4_lm_scores": lm.query,
    "op5_neighbours": neighbours.query,
    "op6_language_id": langid.query,
    "op7_token_files": token_files.query,
    "op8_pii": pii.query,
    "op9_decontamination": decontaminate.query,
    "op10_byte_bpe": bpe.query,
    "op11_merkle": merkle.query,
    "op12_topk": topk.query,
    "op13_align": align.query,
}

ORACLE_SQL: dict[str, str] = {"op11_merkle": merkle.SQL, "op12_topk": topk.SQL}
