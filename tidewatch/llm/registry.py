"""Queries of the corpus operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import op1_media, op2_records, op3_chat, op4_repeats, op5_ppm, op6_mix, op7_pii, op8_quality, op9_pack, op10_near, op11_fim, op12_families, op13_language

QUERIES = {
    "op1_media": op1_media.op1_media,
    "op2_records": op2_records.op2_records,
    "op3_chat": op3_chat.op3_chat,
    "op4_repeats": op4_repeats.op4_repeats,
    "op5_ppm": op5_ppm.op5_ppm,
    "op6_mix": op6_mix.op6_mix,
    "op7_pii": op7_pii.op7_pii,
    "op8_quality": op8_quality.op8_quality,
    "op9_pack": op9_pack.op9_pack,
    "op10_near": op10_near.op10_near,
    "op11_fim": op11_fim.op11_fim,
    "op12_families": op12_families.op12_families,
    "op13_language": op13_language.op13_language,
}
ORACLE_SQL = {"op3_chat": op3_chat.ORACLE_SQL, "op11_fim": op11_fim.ORACLE_SQL, "op12_families": op12_families.ORACLE_SQL}
