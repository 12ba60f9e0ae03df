"""Operators for preparing large text corpora.

Every module is self-contained: nothing outside this subpackage imports it.
"""
