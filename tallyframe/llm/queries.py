"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, fixity, language, near_copies, page_text, secret_ledger, segmentations, token_files, toxicity, vector_links

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_copies": near_copies.op1_near_copies,
        "op2_token_files": token_files.op2_token_files,
        "op3_secret_ledger": secret_ledger.op3_secret_ledger,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_fixity": fixity.op5_fixity,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_page_text": page_text.op7_page_text,
        "op8_segmentations": segmentations.op8_segmentations,
        "op9_language": language.op9_language,
        "op10_vector_links": vector_links.op10_vector_links,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_ledger": secret_ledger.SQL,
        "op5_fixity": fixity.SQL,
        "op6_decontaminate": decontaminate.SQL,
        "op10_vector_links": vector_links.SQL,
    }
