"""Operators for building training data at scale.

Nothing outside this subpackage imports it; its queries and SQL are in
``cohortlens.llm.queries`` and ``cohortlens.llm.oracles``.
"""
