"""Operators for preparing large text corpora (training-data pipelines).

One module per operator; :mod:`ravel.llm.queries` registers one query per
operator. Nothing outside this subpackage imports it."""
