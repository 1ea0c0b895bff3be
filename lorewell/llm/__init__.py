"""Operators for preparing text corpora at scale.

Every operator takes and returns DataFrames.  The thin ``opN_*`` queries over
them live in :mod:`lorewell.llm.queries`.
"""
