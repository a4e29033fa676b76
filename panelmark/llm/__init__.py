"""Operators that prepare a corpus for training a language model.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five.
"""
