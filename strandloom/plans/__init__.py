"""Compositions of operators: whole pipelines and the query catalogue."""
