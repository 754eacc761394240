"""Operators for training-data corpora: tokens, pages, lines, near copies, quality.

Every operator takes and returns DataFrames. Nothing outside this subpackage
imports it; ``queries`` collects its registered queries.
"""
