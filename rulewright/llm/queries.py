"""Queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat_format import OP8_SQL, op8_chat_format
from .decontaminate import OP3_SQL, op3_decontaminate
from .jaccard_join import OP4_SQL, op4_jaccard_join
from .language_id import op1_language_id
from .line_templates import op10_line_dedup
from .lm_score import op2_lm_score
from .media import op7_media_columns
from .mixing import op9_mix_sources
from .suffix_dedup import OP6_SQL, op6_suffix_dedup
from .url_filter import op5_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lm_score": op2_lm_score,
    "op3_decontaminate": op3_decontaminate,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_media_columns": op7_media_columns,
    "op8_chat_format": op8_chat_format,
    "op9_mix_sources": op9_mix_sources,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL = {
    "op3_decontaminate": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op8_chat_format": OP8_SQL,
}
