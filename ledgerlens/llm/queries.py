"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op4_benchmark_decontamination
from .filter_audit import OP13_SQL, op13_filter_interaction_audit
from .html_extract import op9_html_extraction
from .jaccard_join import op6_jaccard_join
from .language_id import op1_language_id
from .license_scan import op3_license_scans
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import op8_mixing
from .quality import op11_quality_classifier
from .sharding import op5_sharding
from .substring_dedup import op2_substring_dedup
from .topk import OP7_SQL, op7_exact_topk
from .vector_codes import OP12_SQL, op12_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_id,
            op2_substring_dedup,
            op3_license_scans,
            op4_benchmark_decontamination,
            op5_sharding,
            op6_jaccard_join,
            op7_exact_topk,
            op8_mixing,
            op9_html_extraction,
            op10_line_dedup,
            op11_quality_classifier,
            op12_vector_codes,
            op13_filter_interaction_audit,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": OP7_SQL, "op10_line_dedup": OP10_SQL, "op12_vector_codes": OP12_SQL, "op13_filter_interaction_audit": OP13_SQL}
