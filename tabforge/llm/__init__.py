"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; its queries are registered by
``tabforge.llm.queries``.
"""
