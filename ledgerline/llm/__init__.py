"""Operators for preparing language-model training data.

Nothing outside this package imports it; delete the folder and the rest of the library still works.
"""
