"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from nearfold.llm.chat_format import OP4_SQL, op4_perspective_rotation
from nearfold.llm.class_lm import op10_class_lm
from nearfold.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from nearfold.llm.line_dedup import op8_line_dedup
from nearfold.llm.mixing import OP5_SQL, op5_mixing
from nearfold.llm.quality import op6_quality_rules
from nearfold.llm.sentencepiece_nbest import op1_sentencepiece
from nearfold.llm.simhash import op7_simhash
from nearfold.llm.substring_dedup import op9_substring_dedup
from nearfold.llm.token_counts import op2_token_counts

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_perspective_rotation": op4_perspective_rotation,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_class_lm": op10_class_lm,
}

SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op4_perspective_rotation": OP4_SQL,
    "op5_mixing": OP5_SQL,
}
