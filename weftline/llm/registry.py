"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, decontaminate, fingerprints, html_pages, lines, order_minhash, packing, repeats, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": html_pages.op1_main_text,
        "op2_token_files": token_files.op2_token_files,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_suffix_dedup": repeats.op5_suffix_dedup,
        "op6_order_minhash": order_minhash.op6_order_minhash,
        "op7_warc_index": archive.op7_warc_index,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_fuzzy_lines": lines.op9_fuzzy_lines,
        "op10_simhash_near_duplicates": fingerprints.op10_simhash_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontaminate.OP4_SQL,
        "op7_warc_index": archive.OP7_SQL,
    }
