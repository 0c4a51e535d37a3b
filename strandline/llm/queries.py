"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from .op1_decontamination import SQL as SQL1, op1_decontamination
from .op10_near_dedup import op10_near_dedup
from .op11_hard_negatives import SQL as SQL11, op11_hard_negatives
from .op12_token_alignment import op12_token_alignment
from .op13_vector_search import SQL as SQL13, op13_vector_search
from .op2_bpe import op2_bpe
from .op3_chat_format import SQL as SQL3, op3_chat_format
from .op4_url_filter import SQL as SQL4, op4_url_filter
from .op5_token_files import op5_token_files
from .op6_html_text import op6_html_text
from .op7_exact_dedup import SQL as SQL7, op7_exact_dedup
from .op8_line_dedup import SQL as SQL8, op8_line_dedup
from .op9_toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_bpe, op3_chat_format, op4_url_filter, op5_token_files, op6_html_text, op7_exact_dedup, op8_line_dedup, op9_toxicity, op10_near_dedup, op11_hard_negatives, op12_token_alignment, op13_vector_search)}
SQL = {"op1_decontamination": SQL1, "op3_chat_format": SQL3, "op4_url_filter": SQL4, "op7_exact_dedup": SQL7, "op8_line_dedup": SQL8, "op11_hard_negatives": SQL11, "op13_vector_search": SQL13}
