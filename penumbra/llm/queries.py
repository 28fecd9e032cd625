"""Registry of the training-data queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, quality_rules
from .decontaminate import op1_decontaminate
from .html_text import op7_html_text
from .langid import op6_language_id
from .lm_scores import op8_lm_scores
from .mixing import op9_mix
from .quality_model import op10_quality
from .quality_rules import op2_quality_rules
from .simhash import op4_simhash
from .substrings import op5_substring_dedup
from .tokens import op3_token_counts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_quality_rules": op2_quality_rules,
        "op3_token_counts": op3_token_counts,
        "op4_simhash": op4_simhash,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_language_id": op6_language_id,
        "op7_html_text": op7_html_text,
        "op8_lm_scores": op8_lm_scores,
        "op9_mix": op9_mix,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL, "op2_quality_rules": quality_rules.SQL, "op9_mix": mixing.SQL}
