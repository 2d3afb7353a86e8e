"""Run-time choice of the attribute order: the first attribute's range is cut into disjoint boxes, each box is counted
under the order that UCB1 picks, and the counts add up. The sum does not depend on the picks."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import functions as F

from tessera.plans.multiway import Relation, Theta, count_bindings, generic_join


@dataclass
class Run:
    count: int = 0
    picks: list[tuple[tuple[str, ...], float]] = field(default_factory=list)  #: order and seconds of each box


class OrderBandit:
    """UCB1 over attribute orders; the reward of an episode is the inverse of its seconds, scaled by the best so far."""

    def __init__(self, orders: Sequence[tuple[str, ...]], exploration: float = 0.5):
        self.orders, self.exploration = list(orders), exploration
        self.plays = dict.fromkeys(self.orders, 0)
        self.speed = dict.fromkeys(self.orders, 0.0)

    def pick(self) -> tuple[str, ...]:
        unplayed = [o for o in self.orders if not self.plays[o]]
        if unplayed:
            return unplayed[0]
        total, best = sum(self.plays.values()), max(self.speed.values())
        return max(self.orders, key=lambda o: self.speed[o] / best + self.exploration * math.sqrt(math.log(total) / self.plays[o]))

    def learn(self, order: tuple[str, ...], seconds: float) -> None:
        self.plays[order] += 1
        self.speed[order] += (1 / max(seconds, 1e-3) - self.speed[order]) / self.plays[order]


def connected_orders(relations: Sequence[Relation], first: str, most: int = 6) -> list[tuple[str, ...]]:
    """Orders that start with one attribute and never bind an attribute without a shared relation."""
    attributes = list(dict.fromkeys(a for r in relations for a in r.attributes))
    linked = {a: {b for r in relations if a in r.attributes for b in r.attributes} for a in attributes}
    found = []
    for rest in permutations([a for a in attributes if a != first]):
        order = (first, *rest)
        if all(linked[a] & set(order[:k]) for k, a in enumerate(order) if k):
            found.append(order)
            if len(found) == most:
                break
    return found


def adaptive_count(relations: Sequence[Relation], theta: Sequence[Theta] = (), first: str | None = None, boxes: int = 8, orders: int = 3) -> Run:
    """Count the join over equal-frequency boxes of the first attribute."""
    first = first or relations[0].attributes[0]
    holder = next(r for r in relations if first in r.attributes)
    cuts = sorted(set(holder.df.stat.approxQuantile(first, [k / boxes for k in range(1, boxes)], 0.01)))
    edges = [None, *cuts, None]
    bandit, run = OrderBandit(connected_orders(relations, first, orders)), Run()
    for low, high in zip(edges, edges[1:]):
        box = F.lit(True)
        if low is not None:
            box = box & (F.col(first) >= F.lit(low))
        if high is not None:
            box = box & (F.col(first) < F.lit(high))
        order, began = bandit.pick(), time.perf_counter()
        run.count += count_bindings(generic_join(relations, order, theta, box)).first()["count"]
        run.picks.append((order, time.perf_counter() - began))
        bandit.learn(order, run.picks[-1][1])
    return run
