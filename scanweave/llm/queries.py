"""The corpus queries by name."""

from __future__ import annotations

from .decontamination import OP4_SQL, op4_decontamination
from .fingerprints import op1_document_fingerprints
from .katz import op7_katz_scoring
from .minhash_dedup import OP10_SQL, op10_minhash_dedup
from .packing import op5_packing
from .quality import op6_quality_classifier
from .recompression_dedup import OP9_SQL, op9_substring_dedup
from .rolling import OP12_SQL, op12_rolling_windows
from .secret_scan import OP3_SQL, op3_secret_scan
from .sharding import OP11_SQL, op11_sharding
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op2_token_counts
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_katz_scoring": op7_katz_scoring,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_sharding": op11_sharding,
    "op12_rolling_windows": op12_rolling_windows,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: DuckDB SQL over the same tables.
ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_minhash_dedup": OP10_SQL,
    "op11_sharding": OP11_SQL,
    "op12_rolling_windows": OP12_SQL,
}
