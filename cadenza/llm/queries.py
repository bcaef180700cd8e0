"""The registered queries of this subpackage and their SQL, where SQL can express one."""

from __future__ import annotations

from cadenza.llm.op1_jaccard import op1_jaccard_join
from cadenza.llm.op2_lm import op2_lm_scores
from cadenza.llm.op3_decontaminate import op3_decontaminate
from cadenza.llm.op4_lines import op4_line_dedup
from cadenza.llm.op5_toxicity import op5_toxicity
from cadenza.llm.op6_token_ids import op6_token_ids
from cadenza.llm.op7_substrings import op7_substring_dedup
from cadenza.llm.op8_bestfit import op8_bestfit_packing
from cadenza.llm.op9_chat import op9_chat_format
from cadenza.llm.op10_quality import op10_quality_rules
from cadenza.llm.op11_spelling import op11_spelling_variants
from cadenza.llm.op12_centroids import ORACLE as OP12_SQL
from cadenza.llm.op12_centroids import op12_centroid_clusters
from cadenza.llm.op13_urls import op13_url_filter

QUERIES = {f.__name__: f for f in (
    op1_jaccard_join, op2_lm_scores, op3_decontaminate, op4_line_dedup, op5_toxicity, op6_token_ids, op7_substring_dedup,
    op8_bestfit_packing, op9_chat_format, op10_quality_rules, op11_spelling_variants, op12_centroid_clusters, op13_url_filter)}

ORACLES: dict[str, str] = {"op12_centroid_clusters": OP12_SQL}
