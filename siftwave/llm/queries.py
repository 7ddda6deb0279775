"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from .bpe import op12_bpe
from .chat import OP2_SQL, op2_chat_rotation
from .decontaminate import OP10_SQL, op10_decontaminate
from .fill_middle import OP11_SQL, op11_fill_in_middle
from .html_text import op6_html_text
from .importance import OP13_SQL, op13_resample
from .license_texts import OP4_SQL, op4_license_scan, op4_license_texts
from .lm_score import op5_lm_score
from .minhash import op9_minhash_near_dedup
from .mixing import OP3_SQL, op3_mix_sources
from .quality import OP8_SQL, op8_quality_robust, op8_quality_rules
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_rotation": op2_chat_rotation,
    "op3_mix_sources": op3_mix_sources,
    "op4_license_scan": op4_license_scan,
    "op4_license_texts": op4_license_texts,
    "op5_lm_score": op5_lm_score,
    "op6_html_text": op6_html_text,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op8_quality_robust": op8_quality_robust,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_bpe": op12_bpe,
    "op13_resample": op13_resample,
}

SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op2_chat_rotation": OP2_SQL,
    "op3_mix_sources": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op4_license_texts": OP4_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
    "op8_quality_robust": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_resample": OP13_SQL,
}
