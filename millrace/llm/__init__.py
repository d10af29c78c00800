"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface; ``queries`` holds the thin queries over whole tables.
"""
