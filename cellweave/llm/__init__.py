"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``__spark_entry__.py`` registers its
queries only when it can be imported.
"""
