"""Operators for large training corpora: sharding, near-duplicates, token counts, piece
encoding, toxicity, packing, exact search, quality rules, language-model scores and chats.

Nothing outside this subpackage imports it.
"""
