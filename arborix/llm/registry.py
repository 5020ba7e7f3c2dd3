"""The queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op9_bpe
from .chat import OP10_SQL, op10_chat
from .decontaminate import op8_decontaminate
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .langid import op2_language_id
from .lexical import OP12_SQL, op12_lexical_search
from .merkle import OP13_SQL, op13_merkle_manifest
from .simhash import op5_simhash
from .suffix_dedup import op4_suffix_dedup
from .token_store import op1_token_store
from .topk import OP11_SQL, op11_top_products
from .toxicity import op7_toxicity
from .urlfilter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
    "op11_top_products": op11_top_products,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op6_url_filter": OP6_SQL,
    "op10_chat": OP10_SQL,
    "op11_top_products": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
