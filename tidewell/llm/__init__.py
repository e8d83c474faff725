"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; ``queries`` wraps each as a thin named query.
"""
