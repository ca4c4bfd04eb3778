"""Operators that prepare training corpora for language models.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; ``corpus_pipeline`` at the repository top chains five of them.
"""
