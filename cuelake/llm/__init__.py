"""Training-data operators: deduplication, scoring, redaction, mixing, tokenising.

Nothing outside this subpackage imports it.
"""
