"""The corpus operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from . import langid, minhash, mixing, periods, pieces, quality, repeats, resampling, sharding, token_files, topk, toxicity, winnowing

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_sharding": sharding.op2_sharding,
    "op3_winnowing": winnowing.op3_winnowing,
    "op4_language": langid.op4_language,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality": quality.op7_quality,
    "op8_pieces": pieces.op8_pieces,
    "op9_minhash": minhash.op9_minhash,
    "op10_topk": topk.op10_topk,
    "op11_resampling": resampling.op11_resampling,
    "op12_repeats": repeats.op12_repeats,
    "op13_periods": periods.op13_periods,
}

#: The others are not expressible in SQL to the bit, or too slow on whole tables; tests/llm hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op9_minhash": minhash.ORACLE, "op10_topk": topk.ORACLE}
