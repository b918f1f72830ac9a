"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from lexmill.llm import chunkdedup, decontam, langid, minhash, packing, pii, quality, secrets, tokencount, tokenfile

QUERIES = {
    "op1_pii": pii.op1,
    "op2_language_id": langid.op2,
    "op3_decontamination": decontam.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_secret_scan": secrets.op5,
    "op6_token_counts": tokencount.op6,
    "op7_chunk_dedup": chunkdedup.op7,
    "op8_token_files": tokenfile.op8,
    "op9_minhash_near_dedup": minhash.op9,
    "op10_quality_rules": quality.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontam.ORACLE,
    "op9_minhash_near_dedup": minhash.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
