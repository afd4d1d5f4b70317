"""The operators' queries and SQL, by name."""

from __future__ import annotations

from .ann import op2_ann
from .bytebpe import op3_byte_bpe
from .linededup import OP8_SQL, op8_line_dedup
from .neardup import op9_minhash_dedup
from .packing import op1_packing
from .quality import op5_quality_rules
from .sharding import op10_sharding
from .tokenfile import op6_token_orc
from .toxicity import op4_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_ann": op2_ann,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_orc": op6_token_orc,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_sharding": op10_sharding,
}

ORACLES = {
    "op7_warc": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
}
