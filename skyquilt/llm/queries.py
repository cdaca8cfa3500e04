"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import conversations, licenses, negatives
from .conversations import op13_conversation_trie
from .decontaminate import op1_benchmark_decontamination
from .embeddings import op6_cover_tree_links
from .hmm import op8_hidden_markov_model
from .jaccard import op7_token_combination_join
from .licenses import op2_license_scan
from .mixing import op12_entropy_balancing
from .negatives import op11_product_quantised_negatives
from .packing import op9_best_fit_packing
from .quality import op10_quality_classifier
from .sharding import op3_hypergeometric_sharding
from .suffixes import op4_suffix_array_dedup
from .warc import op5_indexed_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_license_scan,
        op3_hypergeometric_sharding,
        op4_suffix_array_dedup,
        op5_indexed_warc,
        op6_cover_tree_links,
        op7_token_combination_join,
        op8_hidden_markov_model,
        op9_best_fit_packing,
        op10_quality_classifier,
        op11_product_quantised_negatives,
        op12_entropy_balancing,
        op13_conversation_trie,
    )
}
ORACLE: dict[str, str] = {"op2_license_scan": licenses.oracle(), "op11_product_quantised_negatives": negatives.oracle(), "op13_conversation_trie": conversations.oracle()}
