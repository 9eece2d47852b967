"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, jaccard_join, language_id, licenses, line_dedup, mixing, pii, quality, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_quality": quality.op2,
    "op3_token_counts": token_counts.op3,
    "op4_language_id": language_id.op4,
    "op5_licenses": licenses.op5,
    "op6_mixing": mixing.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_pii": pii.op9,
    "op10_decontaminate": decontaminate.op10,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}
