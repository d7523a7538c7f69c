"""Operators for preparing training data at scale.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; :mod:`riskloom.llm.registry` binds them to the tables of a
data folder as the queries ``op1_...`` to ``op10_...``.
"""
