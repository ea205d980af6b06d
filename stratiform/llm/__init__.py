"""Training-data operators: near-duplicate search, dedup, packing, mixing, language ID, secrets.

Nothing outside this package imports it.
"""
