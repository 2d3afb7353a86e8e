"""Scalar helpers on DataFrame columns."""

from tessera.functions.scalar import divide, format_value, nulls_ordered, register_functions

__all__ = ["divide", "format_value", "nulls_ordered", "register_functions"]
