"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``queries`` in each module's ``QUERIES``
dictionary are collected by ``tidemark.llm.registry``.
"""
