"""The corpus queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from .clustering import OP12_SQL, op12_sort_means
from .collocations import OP11_SQL, op11_phrase_collocations
from .decontaminate import op1_bm25_decontaminate
from .line_dedup import OP2_SQL, op2_line_set_join
from .mixing import OP10_SQL, op10_source_mix
from .page_text import op13_page_differencing
from .quality import op6_attention_quality
from .repetition import op3_repetition_coverage
from .sharding import op8_min_cost_reshard
from .simhash import op5_simhash_gray
from .suffix_dedup import op7_previous_factors
from .toxicity import op9_compression_toxicity
from .warc import OP4_SQL, op4_revisit_asof

QUERIES = {
    "op1_bm25_decontaminate": op1_bm25_decontaminate,
    "op2_line_set_join": op2_line_set_join,
    "op3_repetition_coverage": op3_repetition_coverage,
    "op4_revisit_asof": op4_revisit_asof,
    "op5_simhash_gray": op5_simhash_gray,
    "op6_attention_quality": op6_attention_quality,
    "op7_previous_factors": op7_previous_factors,
    "op8_min_cost_reshard": op8_min_cost_reshard,
    "op9_compression_toxicity": op9_compression_toxicity,
    "op10_source_mix": op10_source_mix,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_sort_means": op12_sort_means,
    "op13_page_differencing": op13_page_differencing,
}

ORACLE_SQL = {
    "op2_line_set_join": OP2_SQL,
    "op4_revisit_asof": OP4_SQL,
    "op10_source_mix": OP10_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_sort_means": OP12_SQL,
}
