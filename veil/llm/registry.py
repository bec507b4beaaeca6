"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, lexical_search, mixing, prefix_trie
from .chat_format import op10_chat_format
from .edit_embedding import op7_edit_embedding
from .fm_dedup import op2_fm_dedup
from .language_id import op9_language_id
from .lexical_search import op11_maxscore
from .mixing import op8_mix
from .ngram_join import op5_ngram_join
from .packing import op4_pack
from .prefix_trie import op13_prefix_trie
from .quality_rules import op6_quality_rules
from .suffix_dedup import op3_suffix_dedup
from .token_counts import op1_token_counts
from .token_output import op12_wavelet_output

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_fm_dedup": op2_fm_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pack": op4_pack,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_edit_embedding": op7_edit_embedding,
    "op8_mix": op8_mix,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_maxscore": op11_maxscore,
    "op12_wavelet_output": op12_wavelet_output,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op8_mix": mixing.ORACLE_SQL,
    "op10_chat_format": chat_format.ORACLE_SQL,
    "op11_maxscore": lexical_search.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
