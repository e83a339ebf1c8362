"""Training-data operators: scoring, deduplication, extraction, filtering, packing.

Nothing outside this subpackage imports it; ``palimpsest.llm.queries`` holds the
thin ``opN_*`` queries, and every other module holds one operator.
"""
