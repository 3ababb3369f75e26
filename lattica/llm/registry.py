"""Queries of this folder, one for each operator, and the SQL for those it can express."""

from __future__ import annotations

from .decontamination import ORACLE as ORACLE_8
from .decontamination import op8_decontamination
from .licenses import op5_licenses
from .near_dedup import op7_near_dedup
from .nearest import op10_nearest
from .packing import op3_packing
from .quality import op6_quality
from .substring_dedup import ORACLE as ORACLE_4
from .substring_dedup import op4_substring_dedup
from .suffix_tree import op2_language_model
from .token_counts import op1_token_counts
from .toxicity import op9_toxicity

QUERIES = {q.__name__: q for q in (op1_token_counts, op2_language_model, op3_packing, op4_substring_dedup, op5_licenses, op6_quality, op7_near_dedup, op8_decontamination, op9_toxicity, op10_nearest)}
ORACLE = {"op4_substring_dedup": ORACLE_4, "op8_decontamination": ORACLE_8}
