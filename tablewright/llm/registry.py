"""The queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from .decontam import op2_decontaminate
from .fertility import op8_fertility
from .line_dedup import op10_line_dedup
from .mixing import ORACLE as MIX_SQL
from .mixing import op5_mix
from .ngram_join import ORACLE as JACCARD_SQL
from .ngram_join import op9_ngram_jaccard
from .pii import op4_pii
from .quality import op3_quality
from .secret_scan import op6_secrets
from .substring_dedup import op1_substring_dedup
from .url_filter import op7_url_rules

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_mix": op5_mix,
    "op6_secrets": op6_secrets,
    "op7_url_rules": op7_url_rules,
    "op8_fertility": op8_fertility,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op5_mix": MIX_SQL,
    "op9_ngram_jaccard": JACCARD_SQL,
}
