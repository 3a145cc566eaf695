"""Queries of this subpackage by name, with their DuckDB twins."""

from __future__ import annotations

from ripplework.llm.divergence import OP13_SQL, op13_source_divergence
from ripplework.llm.fingerprints import op5_fingerprints
from ripplework.llm.html_text import op6_html_text
from ripplework.llm.jaccard import OP9_SQL, op9_jaccard_join
from ripplework.llm.lines import op10_line_dedup
from ripplework.llm.mixing import OP7_SQL, op7_mixing, op7_training_order
from ripplework.llm.packing import op2_packing
from ripplework.llm.quality import op1_quality_rules
from ripplework.llm.secrets import op8_secret_scan
from ripplework.llm.suffixes import OP11_SQL, op11_repeated_substrings
from ripplework.llm.token_files import op3_token_files
from ripplework.llm.urls import OP4_SQL, op4_url_filter
from ripplework.llm.whitening import op12_embedding_whitening


def queries() -> dict:
    ops = (op1_quality_rules, op2_packing, op3_token_files, op4_url_filter, op5_fingerprints, op6_html_text, op7_mixing, op7_training_order, op8_secret_scan, op9_jaccard_join, op10_line_dedup, op11_repeated_substrings, op12_embedding_whitening, op13_source_divergence)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op7_mixing": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op11_repeated_substrings": OP11_SQL, "op13_source_divergence": OP13_SQL}
