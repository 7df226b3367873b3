"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .bpe_sql import op7_bpe
from .decontamination import op5_decontamination
from .near_dedup import op6_near_dedup
from .quality_rules import op3_quality_rules
from .sharding import op8_sharding
from .substring_dedup import op10_substring_dedup
from .token_counts import op4_token_counts
from .token_records import op1_token_records
from .toxicity import op9_toxicity
from .warc_audit import ORACLE as WARC_SQL
from .warc_audit import op2_merkle_audit

QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_merkle_audit": op2_merkle_audit,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {"op2_merkle_audit": WARC_SQL}
