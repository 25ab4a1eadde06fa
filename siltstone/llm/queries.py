"""Queries of the subpackage: name to (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from .credentials import op5_credential_links
from .curriculum import OP9_SQL, op9_curriculum
from .graph_index import op13_graph_search
from .host_paths import op3_host_paths
from .langid import op4_word_backoff
from .media import op6_interleaved_media, page_sequences
from .order_minhash import op2_order_minhash
from .perplexity import op1_perplexity_bands
from .rotation import OP7_SQL, op7_perspectives
from .slack_packing import op10_minimum_bin_slack
from .sort_means import OP12_SQL, op12_sort_means
from .url_lists import OP8_SQL, op8_temporal_lists
from .vector_codes import OP11_SQL, op11_exponion_codes

QUERIES = {
    "op1_perplexity_bands": op1_perplexity_bands,
    "op2_order_minhash": op2_order_minhash,
    "op3_host_paths": op3_host_paths,
    "op4_word_backoff": op4_word_backoff,
    "op5_credential_links": op5_credential_links,
    "op6_interleaved_media": op6_interleaved_media,
    "op7_perspectives": op7_perspectives,
    "op8_temporal_lists": op8_temporal_lists,
    "op9_curriculum": op9_curriculum,
    "op10_minimum_bin_slack": op10_minimum_bin_slack,
    "op11_exponion_codes": op11_exponion_codes,
    "op12_sort_means": op12_sort_means,
    "op13_graph_search": op13_graph_search,
    "page_sequences": page_sequences,
}

ORACLES: dict[str, str] = {
    "op7_perspectives": OP7_SQL,
    "op8_temporal_lists": OP8_SQL,
    "op9_curriculum": OP9_SQL,
    "op11_exponion_codes": OP11_SQL,
    "op12_sort_means": OP12_SQL,
}
