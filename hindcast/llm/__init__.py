"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries live in :mod:`hindcast.llm.queries`.
"""
