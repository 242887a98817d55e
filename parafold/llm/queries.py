"""Queries and oracle SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP13_SQL, op13_centroid_clustering
from .decontamination import op9_decontamination
from .fingerprints import op11_fingerprints
from .jaccard import op5_jaccard_join
from .katz import op3_katz_backoff
from .lines import op6_line_dedup
from .packing import op10_packing
from .pii import op4_personal_data
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op2_quality_rules
from .substrings import OP8_SQL, op8_substring_dedup
from .toxicity import op1_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_katz_backoff": op3_katz_backoff,
    "op4_personal_data": op4_personal_data,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_fingerprints": op11_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
