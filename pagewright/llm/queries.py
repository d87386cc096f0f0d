"""Queries of this subpackage for the entry module, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.bpe import op10_byte_level_bpe
from pagewright.llm.html import op3_html_extraction
from pagewright.llm.lines import op9_line_dedup
from pagewright.llm.lm import op7_lm_scoring
from pagewright.llm.packing import op4_best_fit_packing
from pagewright.llm.quality import op2_quality_classifier
from pagewright.llm.rules import op8_quality_rules
from pagewright.llm.simhash import op1_simhash_near_dedup
from pagewright.llm.sketch import op5_document_fingerprints
from pagewright.llm.token_store import op6_token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_quality_classifier,
        op3_html_extraction,
        op4_best_fit_packing,
        op5_document_fingerprints,
        op6_token_ids,
        op7_lm_scoring,
        op8_quality_rules,
        op9_line_dedup,
        op10_byte_level_bpe,
    )
}

ORACLE_SQL: dict[str, str] = {}
