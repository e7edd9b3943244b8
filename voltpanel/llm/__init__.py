"""Operators for preparing training text: each module holds one method and its DataFrame API.

Nothing outside this subpackage imports it; ``queries.py`` holds the named queries.
"""
