"""The subpackage's queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import align, bpe, chat_format, collocations, lm_score, mixing, near_dup, packing, quality_rules, secrets, token_counts, toxicity, vector_dup

QUERIES = {
    "op1_embedding_near_dup": vector_dup.op1_embedding_near_dup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_minhash_near_dup": near_dup.op8_minhash_near_dup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_pack": packing.op11_pack,
    "op12_token_alignment": align.op12_token_alignment,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op1_embedding_near_dup": vector_dup.OP1_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_minhash_near_dup": near_dup.OP8_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
