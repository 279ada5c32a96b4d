"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Every module holds one operator with a
general interface; ``queries.py`` holds the thin queries over the test tables.
"""
