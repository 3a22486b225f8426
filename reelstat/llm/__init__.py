"""Operators for preparing training text at scale, one module each.

Every operator takes DataFrames and column names and returns DataFrames; the
registered queries that apply them to ``documents`` are in ``queries``.
"""
