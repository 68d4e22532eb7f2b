"""Queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from millrace.llm import bpe, chat, embedding_dedup, line_dedup, minhash, mixing, multi_index, quality, secrets, sharding

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.op1,
    "op2_bpe": bpe.op2,
    "op3_quality_classifier": quality.op3,
    "op4_minhash_near_dedup": minhash.op4,
    "op5_secret_scan": secrets.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_source_mixing": mixing.op7,
    "op8_feistel_sharding": sharding.op8,
    "op9_chat_formatting": chat.op9,
    "op10_nearest_vectors": multi_index.op10,
}
ORACLE: dict[str, str] = {
    "op1_embedding_near_dedup": embedding_dedup.ORACLE_OP1,
    "op4_minhash_near_dedup": minhash.ORACLE_OP4,
    "op5_secret_scan": secrets.ORACLE_OP5,
    "op6_line_dedup": line_dedup.ORACLE_OP6,
    "op7_source_mixing": mixing.ORACLE_OP7,
    "op8_feistel_sharding": sharding.ORACLE_OP8,
    "op9_chat_formatting": chat.ORACLE_OP9,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
