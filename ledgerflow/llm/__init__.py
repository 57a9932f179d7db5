"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. Every module has one operator with
a general interface and one thin ``opN_<name>`` query.
"""
