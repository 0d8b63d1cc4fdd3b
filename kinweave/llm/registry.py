"""Queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from kinweave.llm import decontaminate, fuzzylines, jpeg, language, licences, packing, secretscan, simhash, substring, tokencount

QUERIES = {
    "op1_token_counts": tokencount.op1_token_counts,
    "op2_language_id": language.op2_language_id,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_license_scans": licences.op4_license_scans,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_media_columns": jpeg.op6_media_columns,
    "op7_secret_scans": secretscan.op7_secret_scans,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_line_dedup": fuzzylines.op9_line_dedup,
    "op10_substring_dedup": substring.op10_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": decontaminate.ORACLE,
    "op4_license_scans": licences.oracle(),
    "op10_substring_dedup": substring.ORACLE,
}
