"""Training-data operators: quality, dedup, decontamination, sharding, tokens, packing.

Nothing outside this subpackage imports it.  `registry` holds the queries.
"""
