"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from steadfast.llm import byte_bpe, html_consensus, jaccard_join, license_scan, line_dedup, mixing, mpeg_audio, pii_crf, quality_rules, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_mpeg_audio": mpeg_audio.op8_mpeg_audio,
    "op9_pii_crf": pii_crf.op9_pii_crf,
    "op10_html_consensus": html_consensus.op10_html_consensus,
}

SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
}
