"""Operators for preparing training corpora.

Thirteen operators over tables of documents, vectors and urls, each in a module
of its own.
Nothing else in the package imports this subpackage; ``catalog`` lists its
queries for ``__spark_entry__.py``.
"""
