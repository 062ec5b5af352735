"""Operators for preparing training text: filtering, deduplication, mixing, token output and web archives.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the entry module use it.
"""
