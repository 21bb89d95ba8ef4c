"""Registered queries of the text operators and their DuckDB equivalents.

The others have none: trained models, samples, permutations and tokenizers are not SQL. Their tests
compare them with brute force, an exact round trip or held-out labels.
"""

from tsengine.llm.alignment import op11_alignment
from tsengine.llm.chat import OP10_SQL, op10_chat_format
from tsengine.llm.collocation import OP12_SQL, op12_collocation
from tsengine.llm.decontaminate import OP4_SQL, op4_decontamination
from tsengine.llm.jaccard import OP9_SQL, op9_jaccard
from tsengine.llm.mixing import op5_mixing
from tsengine.llm.pii import op8_pii
from tsengine.llm.quality import op2_quality
from tsengine.llm.sharding import op3_sharding
from tsengine.llm.simhash import op13_simhash
from tsengine.llm.tokens import op6_tokens
from tsengine.llm.topk import OP7_SQL, op7_topk
from tsengine.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_tokens": op6_tokens,
    "op7_topk": op7_topk,
    "op8_pii": op8_pii,
    "op9_jaccard": op9_jaccard,
    "op10_chat_format": op10_chat_format,
    "op11_alignment": op11_alignment,
    "op12_collocation": op12_collocation,
    "op13_simhash": op13_simhash,
}

ORACLE = {
    "op4_decontamination": OP4_SQL,
    "op7_topk": OP7_SQL,
    "op9_jaccard": OP9_SQL,
    "op10_chat_format": OP10_SQL,
    "op12_collocation": OP12_SQL,
}
