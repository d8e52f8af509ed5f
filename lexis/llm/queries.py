"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexis.llm import lexical_search, quality, vector_codes
from lexis.llm.byte_pairs import op12_byte_bpe
from lexis.llm.decontamination import op3_decontamination
from lexis.llm.lexical_search import op13_lexical_search
from lexis.llm.line_dedup import op10_line_dedup
from lexis.llm.near_dedup import op7_near_dedup
from lexis.llm.packing import op4_packing
from lexis.llm.quality import op5_quality_rules
from lexis.llm.secrets import op8_secrets
from lexis.llm.substring_dedup import op9_substring_dedup
from lexis.llm.token_counts import op2_token_counts
from lexis.llm.toxicity import op6_toxicity
from lexis.llm.vector_codes import op11_vector_codes
from lexis.llm.warc import op1_warc_records


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc_records,
        op2_token_counts,
        op3_decontamination,
        op4_packing,
        op5_quality_rules,
        op6_toxicity,
        op7_near_dedup,
        op8_secrets,
        op9_substring_dedup,
        op10_line_dedup,
        op11_vector_codes,
        op12_byte_bpe,
        op13_lexical_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
