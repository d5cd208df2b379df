"""The queries of this subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

from .bpe_count import op4_token_counts
from .bytedup import op6_byte_dedup
from .decontaminate import OP10_SQL, op10_decontaminate
from .langid import op3_language_id
from .neardup import op2_near_duplicates
from .packing import op9_best_fit_packing
from .recompress import OP5_SQL, op5_substring_dedup
from .topk import OP1_SQL, op1_exact_top_k
from .toxicity import op8_toxicity
from .warc import OP7_SQL, op7_warc


def queries():
    found = [op1_exact_top_k, op2_near_duplicates, op3_language_id, op4_token_counts, op5_substring_dedup, op6_byte_dedup, op7_warc, op8_toxicity, op9_best_fit_packing, op10_decontaminate]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op1_exact_top_k": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op10_decontaminate": OP10_SQL}
