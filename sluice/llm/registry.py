"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import oracles
from .bpe import op9_byte_bpe
from .compaction import op4_sharding
from .fingerprints import op2_fingerprints
from .line_dedup import op5_line_dedup
from .lm_score import op1_lm_scoring
from .mixing import mixing_targets, op3_mixing
from .quality import op7_quality
from .simhash import op6_simhash
from .token_shards import op10_token_shards
from .toxicity import op8_toxicity

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_fingerprints": op2_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "mixing_targets": oracles.OP3,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_shards": op10_token_shards,
    "mixing_targets": mixing_targets,
}

#: The others are tested against brute force or exact round trips in tests/llm.
ORACLES = {
    "mixing_targets": oracles.OP3,
    "op5_line_dedup": oracles.OP5,
    "op7_quality": oracles.OP7,
}
