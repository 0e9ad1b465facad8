"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from linkweave.llm import html, jpeg, language, licenses, lines, packing, pieces, quality, simhash, toxicity

QUERIES: dict[str, Callable] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_progressive_jpeg": jpeg.op3_progressive_jpeg,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_language_id": language.op5_language_id,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.OP2_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op9_quality_rules": quality.OP9_SQL,
}
