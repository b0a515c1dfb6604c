"""Training-data operators: deduplication, quality, tokenisation, packing and search.

Nothing outside this subpackage imports it; its queries live in ``icewake.llm.queries``.
"""
