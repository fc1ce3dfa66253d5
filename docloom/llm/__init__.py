"""Operators of a training-data pipeline: joins, classifiers, scans, mixing and sharding over documents.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames to a DataFrame; the
thin queries over the test tables are in :mod:`docloom.llm.catalogue`.
"""
