"""The registered queries of this package, and SQL where it can say the same."""

from . import (
    op1_ppm_score,
    op2_block_topk,
    op3_url_filter,
    op4_warc_index,
    op5_license_scan,
    op6_language_mixture,
    op7_qgram_decontamination,
    op8_disclosure,
    op9_prefix_tree_join,
    op10_best_fit_packing,
    op11_zstd_quality,
    op12_cover_tree_codes,
    op13_token_alignment,
)

_ALL = [
    op1_ppm_score, op2_block_topk, op3_url_filter, op4_warc_index, op5_license_scan, op6_language_mixture, op7_qgram_decontamination,
    op8_disclosure, op9_prefix_tree_join, op10_best_fit_packing, op11_zstd_quality, op12_cover_tree_codes, op13_token_alignment,
]
QUERIES = {m.__name__.rsplit(".", 1)[-1]: m.query for m in _ALL}
QUERIES["op5_license_passages"] = op5_license_scan.passages_query
QUERIES["op9_links_per_document"] = op9_prefix_tree_join.links_query
SQL: dict[str, str] = {m.__name__.rsplit(".", 1)[-1]: m.SQL for m in _ALL if hasattr(m, "SQL")}
