"""Compositions of operators: stages, evaluation, the query registry."""
