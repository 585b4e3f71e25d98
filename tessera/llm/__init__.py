"""Training-data operators: scoring, classification, near-duplicate search, mixing and packing.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
