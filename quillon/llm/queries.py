"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quillon.llm import decontaminate, exact_dedup, pii, substring_dedup, warc
from quillon.llm.bpe import op2_bpe
from quillon.llm.decontaminate import op8_decontamination
from quillon.llm.exact_dedup import op4_exact_dedup
from quillon.llm.language_id import op10_language_id
from quillon.llm.near_dedup import op9_near_dedup
from quillon.llm.pii import op1_pii
from quillon.llm.substring_dedup import op5_substring_dedup
from quillon.llm.token_count import op7_token_counts
from quillon.llm.toxicity import op3_toxicity
from quillon.llm.warc import op6_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op1_pii": pii.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
}
