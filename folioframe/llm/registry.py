"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import html, language, licenses, middle, mixing, neardup, packing, pieces, quality, sharding, tiff, urls, variants

QUERIES = {
    "op1_tiff_pages": tiff.op1_tiff_pages,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_language_id": language.op4_language_id,
    "op5_host_rules": quality.op5_host_rules,
    "op6_kd_shards": sharding.op6_kd_shards,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_main_text": html.op8_main_text,
    "op9_url_filter": urls.op9_url_filter,
    "op10_piece_ids": pieces.op10_piece_ids,
    "op11_packed_sequences": packing.op11_packed_sequences,
    "op12_middle_cuts": middle.op12_middle_cuts,
    "op13_spelling_variants": variants.op13_spelling_variants,
}
ORACLES = {
    "op2_near_duplicates": neardup.SQL_OP2,
    "op3_source_mix": mixing.SQL_OP3,
    "op5_host_rules": quality.SQL_OP5,
    "op7_license_scan": licenses.SQL_OP7,
    "op9_url_filter": urls.SQL_OP9,
    "op12_middle_cuts": middle.SQL_OP12,
    "op13_spelling_variants": variants.SQL_OP13,
}
