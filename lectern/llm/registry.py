"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from lectern.llm.bpe import op3_byte_bpe
from lectern.llm.packing import op4_power_of_two_packing
from lectern.llm.pseudonyms import op1_feistel_pseudonyms
from lectern.llm.quality import op9_attention_quality
from lectern.llm.sharding import op5_hypergeometric_sharding
from lectern.llm.simhash import op10_simhash_ball_hashing
from lectern.llm.sketches import op8_invertible_sketch
from lectern.llm.topk import OP2_SQL, op2_pivot_top_k
from lectern.llm.toxicity import op6_convolutional_toxicity
from lectern.llm.urls import OP7_SQL, op7_url_trie

QUERIES = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_pivot_top_k": op2_pivot_top_k,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_power_of_two_packing": op4_power_of_two_packing,
    "op5_hypergeometric_sharding": op5_hypergeometric_sharding,
    "op6_convolutional_toxicity": op6_convolutional_toxicity,
    "op7_url_trie": op7_url_trie,
    "op8_invertible_sketch": op8_invertible_sketch,
    "op9_attention_quality": op9_attention_quality,
    "op10_simhash_ball_hashing": op10_simhash_ball_hashing,
}

ORACLES: dict[str, str] = {
    "op2_pivot_top_k": OP2_SQL,
    "op7_url_trie": OP7_SQL,
}
