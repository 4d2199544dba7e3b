"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .decontaminate import OP4_SQL, op4_benchmark_decontamination
from .jaccard import OP7_SQL, op7_ngram_jaccard_join
from .langid import op3_language_id
from .licenses import op8_license_scan
from .packing import op1_best_fit_packing
from .quality import OP2_SQL, op2_quality_rules
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .token_store import op9_token_ids
from .url_filter import OP5_SQL, op5_url_filters
from .warc import OP6_SQL, op6_warc_index

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_url_filters": op5_url_filters,
    "op6_warc_index": op6_warc_index,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_token_ids": op9_token_ids,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE = {
    "op2_quality_rules": OP2_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_url_filters": OP5_SQL,
    "op6_warc_index": OP6_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op10_substring_dedup": OP10_SQL,
}
