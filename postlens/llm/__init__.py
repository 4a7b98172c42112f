"""Training-data operators: sharding, deduplication, mixing, filtering, packing, formatting.

Nothing outside this folder imports it.
"""
