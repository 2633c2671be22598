"""The queries opN_<name> of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from . import minhash, pq, quality, secret_scan
from .langid import op7_language_id
from .minhash import op2_minhash
from .packing import op5_packing
from .pii import op10_pii
from .pq import op1_embedding_dedup
from .quality import op6_quality_rules
from .secret_scan import op8_secret_scans
from .spm import op3_sentencepiece
from .substrings import op9_substring_dedup
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_minhash, op3_sentencepiece, op5_packing, op6_quality_rules, op7_language_id, op8_secret_scans, op9_substring_dedup, op4_toxicity, op10_pii)}
CHECK_SQL: dict[str, str] = {"op1_embedding_dedup": pq.SQL, "op2_minhash": minhash.SQL, "op6_quality_rules": quality.SQL, "op8_secret_scans": secret_scan.SQL}
