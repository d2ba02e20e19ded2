"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from sinktrace.llm.alignment import op13_alignment
from sinktrace.llm.byte_bpe import op10_byte_bpe
from sinktrace.llm.decontaminate import op1_decontaminate
from sinktrace.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from sinktrace.llm.jaccard_join import OP12_SQL, op12_jaccard_join
from sinktrace.llm.pii import op5_pii
from sinktrace.llm.ppm import op2_ppm
from sinktrace.llm.quality_model import op4_quality_model
from sinktrace.llm.quality_rules import op6_quality_rules
from sinktrace.llm.repeats import OP3_SQL, op3_repeats
from sinktrace.llm.simhash import op9_simhash
from sinktrace.llm.token_counts import op7_token_counts
from sinktrace.llm.token_files import op8_token_files

QUERIES = {"op3_repeats": op3_repeats, "op7_token_counts": op7_token_counts, "op1_decontaminate": op1_decontaminate, "op2_ppm": op2_ppm, "op4_quality_model": op4_quality_model, "op6_quality_rules": op6_quality_rules, "op9_simhash": op9_simhash, "op5_pii": op5_pii, "op8_token_files": op8_token_files, "op10_byte_bpe": op10_byte_bpe, "op11_hard_negatives": op11_hard_negatives, "op12_jaccard_join": op12_jaccard_join, "op13_alignment": op13_alignment}
ORACLE_SQL: dict[str, str] = {"op3_repeats": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op12_jaccard_join": OP12_SQL}
