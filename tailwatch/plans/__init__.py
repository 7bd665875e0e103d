"""Compositions of operators: stages, marts, evaluations, and the query registry."""
