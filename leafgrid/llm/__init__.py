"""Operators for building training corpora: mixing, tokenising, filtering, deduplication and scans.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general
interface; ``queries`` holds the thin registered queries.
"""
