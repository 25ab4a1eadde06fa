"""Operators for preparing language-model training data at scale.

Nothing else in the package imports this subpackage.
"""
