"""Training-data operators: language ID, packing, search, PII, LM scoring, chats, tokens, joins, dedup, quality.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` are in ``gristmill.llm.registry``.
"""
