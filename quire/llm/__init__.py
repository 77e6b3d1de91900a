"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the entry module adds its queries only when it is present.
"""
