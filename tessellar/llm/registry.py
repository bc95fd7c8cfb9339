"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from tessellar.llm.decontaminate import OP3_SQL, op3_benchmark_decontamination
from tessellar.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tessellar.llm.line_dedup import OP7_SQL, op7_line_dedup
from tessellar.llm.lm_score import op10_lm_score
from tessellar.llm.minhash import OP6_SQL, op6_minhash_dedup
from tessellar.llm.packing import op2_packing
from tessellar.llm.secrets import op8_secret_scan
from tessellar.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from tessellar.llm.toxicity import op9_toxicity
from tessellar.llm.url_filter import op5_url_filter

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_packing": op2_packing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_lm_score": op10_lm_score,
}

SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op6_minhash_dedup": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
}
