"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lodestone.llm import chat
from lodestone.llm.classlm import op9_lm_scores
from lodestone.llm.decontaminate import op8_decontaminate
from lodestone.llm.htmltext import op6_html_text
from lodestone.llm.linededup import op5_line_dedup, op5_sql
from lodestone.llm.mixing import op4_mix_sources, op4_sql
from lodestone.llm.ordermin import op7_fingerprints
from lodestone.llm.quality import op10_quality
from lodestone.llm.simhash import op1_simhash_near_dedup
from lodestone.llm.tokencount import op2_token_counts

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_chat_format": chat.op3_chat_format,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_dedup": op5_line_dedup,
    "op6_html_text": op6_html_text,
    "op7_fingerprints": op7_fingerprints,
    "op8_decontaminate": op8_decontaminate,
    "op9_lm_scores": op9_lm_scores,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op3_chat_format": chat.op3_sql(), "op4_mix_sources": op4_sql(), "op5_line_dedup": op5_sql()}
