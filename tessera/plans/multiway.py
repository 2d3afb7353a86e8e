"""Generic join: a worst-case-optimal plan for cyclic equi-joins, as a chain of DataFrame joins and semi-joins.

One attribute is bound at a time. The relation with the smallest estimated extension extends the bindings; every other
relation whose remaining attributes are bound cuts them down by a semi-join before the next attribute is bound, so
intermediate results never hold bindings that a fully bound relation already excludes. Catalyst picks the physical
joins (broadcast below the threshold, sort-merge with skew splitting above).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "__weight"


@dataclass
class Relation:
    """Rows over named join attributes. ``distinct`` says that no row repeats; otherwise multiplicities are kept."""

    name: str
    df: DataFrame
    attributes: tuple[str, ...]
    distinct: bool = True
    rows: float = 1.0
    keys: dict[str, float] = field(default_factory=dict)  #: distinct values of an attribute, where known

    def extension(self, bound: Iterable[str]) -> float:
        """Estimated rows for one binding of the bound attributes."""
        size = self.rows
        for attribute in set(bound) & set(self.attributes):
            size /= max(1.0, self.keys.get(attribute, self.rows**0.5))
        return size


@dataclass(frozen=True)
class Theta:
    """A predicate over attributes, applied as soon as all of them are bound."""

    attributes: tuple[str, ...]
    condition: Callable[[], Column]


def attribute_classes(equalities: Iterable[tuple[str, str]]) -> list[frozenset[str]]:
    """Classes of columns that equi-join predicates equate, directly or through others."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in equalities:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    groups: dict[str, set[str]] = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return sorted((frozenset(g) for g in groups.values()), key=min)


def order_attributes(relations: Sequence[Relation]) -> tuple[str, ...]:
    """Attributes by the number of relations that hold them, each connected to those before where possible."""
    attributes = list(dict.fromkeys(a for r in relations for a in r.attributes))
    degree = {a: sum(a in r.attributes for r in relations) for a in attributes}
    order: list[str] = []
    while len(order) < len(attributes):
        rest = [a for a in attributes if a not in order]
        linked = [a for a in rest if any(a in r.attributes and set(r.attributes) & set(order) for r in relations)]
        order.append(max(linked or rest, key=lambda a: (sum(a in r.attributes and bool(set(r.attributes) & set(order)) for r in relations), degree[a], -attributes.index(a))))
    return tuple(order)


def _source(relation: Relation, wanted: Sequence[str]) -> tuple[DataFrame, bool]:
    """The relation over some of its attributes, without repeats; whether it carries multiplicities."""
    whole = set(wanted) == set(relation.attributes)
    if whole and not relation.distinct:
        return relation.df.groupBy(*wanted).agg(F.count(F.lit(1)).alias(f"{WEIGHT}_new")), True
    df = relation.df.select(*wanted)
    return (df if whole else df.distinct()), False


def generic_join(relations: Sequence[Relation], order: Sequence[str] | None = None, theta: Sequence[Theta] = (), box: Column | None = None) -> DataFrame:
    """Bindings of all attributes, with a multiplicity column where a relation has repeats.

    Null attributes never join. ``box`` restricts the first attribute of the order.
    """
    order = tuple(order or order_attributes(relations))
    bound: list[str] = []
    out: DataFrame | None = None
    waiting, pending = list(relations), list(theta)

    def absorb(left: DataFrame, right: DataFrame, weighted: bool, keys: list[str], how: str) -> DataFrame:
        if not weighted:
            return left.join(right, keys, how)
        joined = left.join(right, keys, "inner")
        if WEIGHT in left.columns:
            return joined.withColumn(WEIGHT, F.col(WEIGHT) * F.col(f"{WEIGHT}_new")).drop(f"{WEIGHT}_new")
        return joined.withColumnRenamed(f"{WEIGHT}_new", WEIGHT)

    for attribute in order:
        holders = [r for r in waiting if attribute in r.attributes]
        if not holders:
            raise ValueError(f"no relation binds {attribute}")
        linked = [r for r in holders if set(r.attributes) & set(bound)] or holders
        first = min(linked, key=lambda r: r.extension(bound))
        shared = [a for a in first.attributes if a in bound]
        right, weighted = _source(first, [*shared, attribute])
        right = right.where(F.col(attribute).isNotNull())
        if out is None:
            out = right.where(box) if box is not None else right
            if weighted:
                out = out.withColumnRenamed(f"{WEIGHT}_new", WEIGHT)
        else:
            out = absorb(out, right, weighted, shared, "inner") if shared else out.crossJoin(right)
        bound.append(attribute)
        if set(first.attributes) <= set(bound):
            waiting.remove(first)
        ready = [t for t in pending if set(t.attributes) <= set(bound)]
        for t in ready:
            out = out.where(t.condition())
            pending.remove(t)
        for r in [r for r in waiting if attribute in r.attributes and set(r.attributes) <= set(bound)]:
            right, weighted = _source(r, list(r.attributes))
            out = absorb(out, right, weighted, list(r.attributes), "left_semi")
            waiting.remove(r)
    return out


def count_bindings(bindings: DataFrame) -> DataFrame:
    """COUNT(*) of the join under bag semantics."""
    if WEIGHT in bindings.columns:
        return bindings.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).cast("bigint").alias("count"))
    return bindings.agg(F.count(F.lit(1)).alias("count"))


def pattern_relations(edges: DataFrame, pairs: Sequence[tuple[int, int]], ordered: bool = True) -> list[Relation]:
    """One relation per vertex pair. With ordered vertices, every pair (a < b) needs the increasing half only."""
    half = edges.where("sid < tid") if ordered else edges
    return [Relation(f"e{n}", half.select(F.col("sid").alias(f"v{a}"), F.col("tid").alias(f"v{b}")), (f"v{a}", f"v{b}")) for n, (a, b) in enumerate(pairs, 1)]
