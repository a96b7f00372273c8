"""Operators that prepare text corpora for training language models.

Nothing outside this subpackage imports it; ``vellum.llm.queries`` registers its queries.
"""
