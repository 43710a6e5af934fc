"""Operators for preparing training data at scale.

Nothing outside this folder imports it.  Each module holds one operator; :mod:`polygate.llm.queries` binds them to the
synthetic tables.
"""
