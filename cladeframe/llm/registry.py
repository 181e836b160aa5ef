"""The queries of the operators here and their SQL."""

from . import binary_records, chat_format, conversation_repair, edit_embedding, gray_index, language_id, lexical_search, packing, pii_crf, site_tree, spaced_seeds, token_counts, toxicity

_MODULES = [chat_format, binary_records, language_id, toxicity, token_counts, packing, site_tree, gray_index, edit_embedding, spaced_seeds, lexical_search, pii_crf, conversation_repair]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
