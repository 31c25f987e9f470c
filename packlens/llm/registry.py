"""The queries of this subpackage and, where SQL can express them, the same results in SQL."""

from __future__ import annotations

from .embeddings import op6_embedding_near_dedup
from .jaccard import op1_ngram_jaccard
from .language import op4_language_id
from .mixing import OP3_SQL, op3_mixing
from .neighbours import op7_nearest
from .oracles import OP1_SQL, OP5_SQL, OP6_SQL
from .packing import op8_packing
from .secrets import op10_secret_scan
from .suffixes import op5_suffix_dedup
from .urls import OP9_SQL, op9_url_filters
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_nearest": op7_nearest,
    "op8_packing": op8_packing,
    "op9_url_filters": op9_url_filters,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES = {
    "op1_ngram_jaccard": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op9_url_filters": OP9_SQL,
}
