"""Plans for graph patterns and cyclic multiway joins."""

from tessera.plans.adaptive import adaptive_count
from tessera.plans.cycles import bounded_cycles
from tessera.plans.multiway import Relation, attribute_classes, count_bindings, generic_join, order_attributes
from tessera.plans.patterns import Pattern, edge_view, pattern

__all__ = ["Pattern", "Relation", "adaptive_count", "attribute_classes", "bounded_cycles", "count_bindings", "edge_view", "generic_join", "order_attributes", "pattern"]
