"""Operators for preparing training data at corpus scale.

Nothing outside this folder imports it; the queries of these operators are in
``tessera.llm.queries``.
"""
