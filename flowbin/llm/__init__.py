"""Training-data operators: dedup, archives, filtering, extraction, tokenising, chat data.

Nothing outside this subpackage imports it.
"""
