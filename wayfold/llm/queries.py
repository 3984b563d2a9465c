"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op7_decontamination
from .html_extraction import op4_html_extraction
from .license_scan import op10_license_scan
from .lm_scoring import op8_lm_scoring
from .near_dedup import op5_near_dedup
from .oracles import OP2_SQL, OP5_SQL, OP9_SQL
from .packing import op6_packing
from .quality_rules import OP1_SQL, op1_quality_rules
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op3_token_counts

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_html_extraction": op4_html_extraction,
    "op5_near_dedup": op5_near_dedup,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op5_near_dedup": OP5_SQL, "op9_suffix_dedup": OP9_SQL}
