"""The operators' registered queries and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oeeforge.llm import (
    bm25_decontaminate,
    cotrain_quality,
    drift_clusters,
    edit_counts,
    line_spread,
    metric_join,
    multiset_hash,
    overlap_join,
    page_template,
    pii_bootstrap,
    piece_codec,
    token_file,
    vector_codes,
)

_MODULES = {
    "op1_pii_bootstrap": pii_bootstrap,
    "op2_page_template": page_template,
    "op3_multiset_hash": multiset_hash,
    "op4_bm25_decontaminate": bm25_decontaminate,
    "op5_cotrain_quality": cotrain_quality,
    "op6_overlap_join": overlap_join,
    "op7_piece_codec": piece_codec,
    "op8_edit_counts": edit_counts,
    "op9_token_file": token_file,
    "op10_line_spread": line_spread,
    "op11_vector_codes": vector_codes,
    "op12_metric_join": metric_join,
    "op13_drift_clusters": drift_clusters,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if hasattr(module, "ORACLE_SQL")}
