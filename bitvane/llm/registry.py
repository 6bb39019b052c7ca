"""Queries of the training-data operators and of the pipeline, and their SQL where there is any."""

import corpus_pipeline

from . import byte_bpe, exact_dedup, fingerprint, html_text, jaccard_join, lang_id, lexical_search, near_dedup, packing, prefix_trie, token_counts, toxicity, warc

_MODULES = (toxicity, packing, html_text, lang_id, exact_dedup, fingerprint, warc, byte_bpe, near_dedup, token_counts, prefix_trie, jaccard_join, lexical_search)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
