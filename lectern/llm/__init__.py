"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`lectern.llm.queries` derives the digest columns
of the registered queries from those operators.
"""
