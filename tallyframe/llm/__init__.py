"""Training-data operators: deduplication, scanning, scoring, extraction and encoding of text.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` below are what the entry
module adds to its own.
"""
