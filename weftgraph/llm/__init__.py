"""Operators for preparing text corpora: the corpus operators and their queries.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the repository top chains
five of its operators.
"""
