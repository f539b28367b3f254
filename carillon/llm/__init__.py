"""Training-data operators: packing, dedup, quality, search, tokenisation, audit, privacy.

Nothing outside this subpackage imports it; ``registry`` holds its queries and SQL.
"""
