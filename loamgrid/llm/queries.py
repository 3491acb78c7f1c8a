"""Queries of this subpackage and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from loamgrid.llm.centroids import OP12_SQL, op12_centroid_clustering
from loamgrid.llm.exact_topk import OP13_SQL, op13_exact_topk
from loamgrid.llm.language_id import op2_language_id
from loamgrid.llm.line_crf import op7_line_crf
from loamgrid.llm.media_sniff import op6_media_sniff
from loamgrid.llm.merkle import OP11_SQL, op11_merkle_manifest
from loamgrid.llm.packing import op9_packing
from loamgrid.llm.pii import op10_pii
from loamgrid.llm.quality_rules import op1_quality_rules
from loamgrid.llm.simhash import op3_simhash
from loamgrid.llm.source_mixing import OP8_SQL, op8_source_mixing
from loamgrid.llm.substring_dedup import op4_substring_dedup
from loamgrid.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_media_sniff": op6_media_sniff,
    "op7_line_crf": op7_line_crf,
    "op8_source_mixing": op8_source_mixing,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_exact_topk": op13_exact_topk,
}

ORACLE_SQL = {
    "op5_url_filter": OP5_SQL,
    "op8_source_mixing": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_exact_topk": OP13_SQL,
}
