"""What the operators register: queries, and SQL where it can express them."""

from __future__ import annotations

from ledgerflow.llm.archives import ORACLE as WARC_SQL
from ledgerflow.llm.archives import op1_legacy_archives
from ledgerflow.llm.language_model import op5_language_model
from ledgerflow.llm.mixing import op10_mix_sources
from ledgerflow.llm.pieces import op3_sentencepiece
from ledgerflow.llm.quality import op9_quality_rules
from ledgerflow.llm.simhash import op4_simhash
from ledgerflow.llm.substrings import ORACLE as SUBSTRINGS_SQL
from ledgerflow.llm.substrings import op2_substring_dedup
from ledgerflow.llm.token_counts import op6_token_counts
from ledgerflow.llm.topk import ORACLE as TOPK_SQL
from ledgerflow.llm.topk import op7_top_k
from ledgerflow.llm.urls import op8_url_filters

QUERIES = {
    "op1_legacy_archives": op1_legacy_archives,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_language_model": op5_language_model,
    "op6_token_counts": op6_token_counts,
    "op7_top_k": op7_top_k,
    "op8_url_filters": op8_url_filters,
    "op9_quality_rules": op9_quality_rules,
    "op10_mix_sources": op10_mix_sources,
}
ORACLES = {"op2_substring_dedup": SUBSTRINGS_SQL, "op1_legacy_archives": WARC_SQL, "op7_top_k": TOPK_SQL}
