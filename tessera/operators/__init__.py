"""Relational operators that need more than one DataFrame call."""

from tessera.operators.relational import count_rows, dictionary_encode, distinct_rows, sorted_edges, value_bounds

__all__ = ["count_rows", "dictionary_encode", "distinct_rows", "sorted_edges", "value_bounds"]
