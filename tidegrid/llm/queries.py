"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import conversations, de_bruijn, decontaminate, fingerprint, jaccard, lm, merkle, mixing, packing, quality, suffix_dedup, token_files, urls

QUERIES = {
    "op1_lm_score": lm.op1_lm_score,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_substring_dedup": de_bruijn.op4_substring_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_mix": mixing.op6_mix,
    "op7_url_filter": urls.op7_url_filter,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_token_files": token_files.op9_token_files,
    "op10_quality": quality.op10_quality,
    "op11_conversations": conversations.op11_conversations,
    "op12_pack": packing.op12_pack,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op4_substring_dedup": de_bruijn.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op11_conversations": conversations.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
