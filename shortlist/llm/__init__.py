"""Operators that prepare text and page tables for training language models.

Nothing else in the library imports this package. Each module is one operator;
``queries`` registers one query per operator.
"""
