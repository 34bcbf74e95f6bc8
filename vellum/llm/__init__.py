"""Operators of a training-data pipeline over text and vectors, as Spark jobs.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; what a query of the catalogue returns is derived from them in
``vellum.llm.queries``.
"""
