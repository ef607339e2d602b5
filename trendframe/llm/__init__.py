"""Operators that prepare text for language-model training and evaluation.

Nothing else in the library imports this subpackage.
"""
