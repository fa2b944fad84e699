"""Training-data operators: quality rules, deduplication, packing, token counts,
archives, tokenisation, toxicity and language identification.

Nothing outside this subpackage imports it.
"""
