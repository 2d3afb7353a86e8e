"""Exact top-k inner products: a KD-tree per shard, best-first traversal, and a kth score carried between shards.

Shards are the leaves of a median-split tree over a bounded sample (about ``sample`` rows, chosen by a hash of their id),
so that near vectors share one; shards that turn out too large are dealt on by hash. Of equal vectors only the k + 1
smallest ids can be among anyone's first k, and only these are candidates. A shard's own tree splits at the median of the
widest dimension and keeps tight boxes; no vector of a box can score more than the sum of max(q*low, q*high), so a query
takes leaves best-first and stops when the best bound is below its kth score; the queries that are at one leaf are scored
together. Each query first searches the shard that it falls in; its kth score there goes along to the other shards whose
box can still reach it (all of them, beyond ``boxes`` shards), which return only what can still be among the first k.
A shard's tree is built once for each of the two rounds, and queries stream through it.

Defined results: vectors that are null or hold null or non-finite components (256 x included), and rows without an id, take
no part; vectors meet vectors of their own length only; rows that repeat an id and its vector count once; a query never
meets its own id; ties go to the smaller id; products that doubles cannot hold exactly are computed in whole numbers of any
size, and a score beyond a long counts as the nearest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import keep

FOUND = "query_id bigint, vec_id bigint, score bigint"
LOW, HIGH = -(2**63), 2**63 - 1
EXACT = 2.0**53


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) as whole doubles, which hold it exactly."""
    scaled = F.transform(embedding, lambda x: F.lit(float(scale)) * x.cast("double"))
    return F.transform(scaled, lambda y: y - F.pmod(y, F.lit(1.0)))


def usable(embedding: Column, scale: int = 256) -> Column:
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < float("inf")))


class KDTree:
    """Median splits with tight bounding boxes over whole vectors (as doubles)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = 256):
        order = np.lexsort((ids,))
        self.x, self.ids = vectors[order].astype(np.float64), ids[order]
        self.most = float(np.abs(self.x).max(initial=0))
        self.leaves: list[np.ndarray] = []
        if len(ids):
            self._build(np.arange(len(ids)), leaf)
        self.low = np.array([self.x[rows].min(axis=0, initial=np.inf) for rows in self.leaves])
        self.high = np.array([self.x[rows].max(axis=0, initial=-np.inf) for rows in self.leaves])

    def _build(self, rows: np.ndarray, leaf: int) -> None:
        x = self.x[rows]
        width = x.max(axis=0) - x.min(axis=0) if x.shape[1] else np.zeros(1)
        if len(rows) <= leaf or not width.any():
            self.leaves.append(np.sort(rows))
            return
        cut = np.argpartition(x[:, int(np.argmax(width))], len(rows) // 2)
        self._build(rows[cut[: len(rows) // 2]], leaf)
        self._build(rows[cut[len(rows) // 2 :]], leaf)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest possible score of each query (row) in each leaf (column)."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, k: int, bounds: np.ndarray, least: float) -> list[tuple[float, int]]:
        """Up to k (score, -id) of one query, given its bounds."""
        return [(float(s), -i) for _, i, s in self.search_all(query[None], np.array([own]), k, np.array([least]), bounds[None])]

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray, bounds: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(query, id, score) of up to k best of each query that are not below its ``least``; ``self.visited`` counts
        the pairs of queries and leaves that were scored."""
        self.visited = 0
        if not len(self.ids) or not len(queries):
            return
        if self.most * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) >= EXACT:
            yield from self._search_whole(queries, own, k, least)
            return
        bounds = self.bounds(queries) if bounds is None else bounds
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = np.full((len(queries), k), -np.inf)
        floor = np.where(least <= -EXACT, -np.inf, least.astype(float))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(len(self.leaves)):
            leaf = order[:, step]
            open_ = np.flatnonzero(bounds[np.arange(len(queries)), leaf] >= floor)
            if not len(open_):
                break
            self.visited += len(open_)
            for at in np.unique(leaf[open_]):
                of, rows = open_[leaf[open_] == at], self.leaves[at]
                scores = queries[of] @ self.x[rows].T
                scores[own[of][:, None] == self.ids[rows][None, :]] = -np.inf
                top = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k :] if len(rows) > k else scores
                merged = np.sort(np.hstack([best[of], top]), axis=1)[:, -k:]
                best[of] = merged
                floor[of] = np.maximum(floor[of], merged[:, 0])
                i, j = np.nonzero((scores >= floor[of][:, None]) & (scores > -np.inf))
                found.append((of[i], self.ids[rows[j]], scores[i, j]))
        if found:
            of, ids, scores = map(np.concatenate, zip(*found))
            good = scores >= floor[of]
            of, ids, scores = of[good], ids[good], scores[good]
            order = np.lexsort((ids, -scores, of))
            of, ids, scores = of[order], ids[order], scores[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            for q, i, s in zip(of[rank < k].tolist(), ids[rank < k].tolist(), scores[rank < k].tolist()):
                yield q, i, int(s)

    def _search_whole(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The same in whole numbers of any size, all vectors for each query."""
        vectors = [[int(v) for v in x] for x in self.x.tolist()]
        for q, query in enumerate(queries.tolist()):
            query = [int(v) for v in query]
            scored = sorted((-max(LOW, min(HIGH, sum(a * b for a, b in zip(query, x)))), int(i)) for x, i in zip(vectors, self.ids) if i != own[q])
            for score, i in scored[:k]:
                if -score >= int(least[q]):
                    yield q, i, -score


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _searched(k: int, leaf: int, block_rows: int):
    """Rows (dim, shard, query, id, v, least), a shard's vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            names = [np.asarray(batch.column(c)) for c in range(3)]
            cuts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in names], axis=0), [True]])) if batch.num_rows else []
            for i, j in zip(cuts, cuts[1:]):
                part, key, asked = batch.slice(i, j - i), (names[0][i], names[1][i]), bool(names[2][i])
                if key != now:
                    now, held, tree = key, [], None
                ids, rows = part.column(3).to_numpy(), _matrix(part.column(4), j - i)
                if not asked:
                    held.append((ids, rows))
                    continue
                if tree is None:
                    tree = KDTree(np.concatenate([r for _, r in held]), np.concatenate([x for x, _ in held]), leaf) if held else KDTree(np.zeros((0, 0)), np.zeros(0, np.int64))
                    held = []
                least = part.column(5).to_numpy()
                for at in range(0, j - i, block_rows):
                    mine = slice(at, at + block_rows)
                    found = [(int(ids[at + q]), x, s) for q, x, s in tree.search_all(rows[mine], ids[mine], k, least[mine])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    return run


def splits(x: np.ndarray, most: int) -> list:
    """A tree of median splits (axis, value, left, right) until a leaf has at most ``most`` rows; leaves are None."""
    width = x.max(axis=0) - x.min(axis=0) if x.size else np.zeros(1)
    if len(x) <= most or not width.any():
        return None
    axis = int(np.argmax(width))
    value = float(np.median(x[:, axis]))
    left = x[:, axis] < value
    if not left.any():
        value = float(x[x[:, axis] > value, axis].min())
        left = x[:, axis] < value
    return [axis, value, splits(x[left], most), splits(x[~left], most)]


def _leaves(x: np.ndarray, tree: list | None) -> np.ndarray:
    """The number of each row's leaf."""
    out, stack, n = np.zeros(len(x), np.int64), [(tree, np.arange(len(x)))], 0
    while stack:
        node, rows = stack.pop()
        if node is None:
            out[rows] = n
            n += 1
            continue
        left = x[rows, node[0]] < node[1]
        stack += [(node[2], rows[left]), (node[3], rows[~left])]
    return out


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, shard_rows: int = 8192, block_rows: int = 2048, leaf: int = 256, sample: int = 8192, boxes: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for every query: the rows whose id is divisible by ``every``; ``block_rows`` queries
    are searched together."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("e")).where(F.col("id").isNotNull() & usable(F.col("e")))
    rows = keep(rows.select("id", quantized(F.col("e")).alias("v")).distinct().withColumn("dim", F.size("v")), "vectors")
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, n // sample))) == 0).select("dim", "v").collect() if n > shard_rows else []
    trees = {d: splits(np.array([r.v for r in chosen if r.dim == d], float), max(1, shard_rows * len(chosen) // max(1, n))) for d in {r.dim for r in chosen}}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, leaves = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                leaves[mine] = _leaves(_matrix(batch.column(1).take(pa.array(mine)), len(mine)), trees.get(int(d)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], names=["id", "v", "dim", "leaf"])

    placed = keep(rows.mapInArrow(place, "id bigint, v array<double>, dim int, leaf bigint"), "placed")
    # only the k + 1 smallest ids of equal vectors are candidates; they lie in one leaf
    first = F.row_number().over(W.partitionBy("dim", "v").orderBy("id"))
    candidates = placed.withColumn("n", first).where(F.col("n") <= k + 1).drop("n")
    sizes = candidates.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).select("dim", "leaf", F.ceil(F.col("n") / (2 * shard_rows)).cast("int").alias("pieces"))
    sizes = keep(sizes, "leaves")
    shard = F.concat_ws(":", "leaf", F.pmod(F.xxhash64("id"), F.col("pieces")))
    candidates = keep(candidates.join(sizes, ["dim", "leaf"]).select("dim", shard.alias("shard"), F.lit(False).alias("asked"), "id", "v", F.lit(0).cast("bigint").alias("least")), "candidates")
    queries = placed.join(sizes, ["dim", "leaf"]).where(F.col("id") % every == 0).select("dim", shard.alias("home"), "id", "v")
    shards = candidates.select("dim", "shard").distinct()
    parts = max(1, sizes.agg(F.coalesce(F.sum("pieces"), F.lit(1))).first()[0])

    def searched(asked: DataFrame) -> DataFrame:
        every_row = candidates.unionByName(asked.withColumn("asked", F.lit(True)))
        return every_row.repartition(min(parts, 20_000), "dim", "shard").sortWithinPartitions("dim", "shard", "asked").mapInArrow(_searched(k, leaf, block_rows), FOUND)

    home = keep(searched(queries.select("dim", F.col("home").alias("shard"), "id", "v", F.lit(LOW).cast("bigint").alias("least"))), "home")
    kth = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("score")).otherwise(LOW).alias("least"))
    rest = queries.join(kth, "id", "left").select("dim", "home", "id", "v", F.coalesce("least", F.lit(LOW)).alias("least"))
    found = home
    if parts > 1:
        if parts <= boxes:
            rest = _reaching(rest, candidates)
        else:
            rest = rest.join(shards, "dim").where("shard <> home").drop("home")
        found = home.unionByName(searched(rest))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reaching(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each query with the other shards whose boxes allow a score not below its kth; the boxes, two vectors for each of a
    bounded number of shards, go to all tasks."""

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            dims, shards = batch.column(0).to_numpy(), np.asarray(batch.column(1).to_pylist(), object)
            for d, s in set(zip(dims.tolist(), shards.tolist())):
                mine = np.flatnonzero((dims == d) & (shards == s))
                x = _matrix(batch.column(2).take(pa.array(mine)), len(mine))
                low, high = found.get((d, s), (np.inf, -np.inf))
                found[d, s] = np.minimum(low, x.min(axis=0, initial=np.inf)), np.maximum(high, x.max(axis=0, initial=-np.inf))
        if found:
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d for d, _ in found], pa.int32()), "shard": [s for _, s in found], "low": [x.tolist() for x, _ in found.values()], "high": [x.tolist() for _, x in found.values()]})

    parts = candidates.select("dim", "shard", "v").mapInArrow(extents, "dim int, shard string, low array<double>, high array<double>")
    pairs = F.arrays_zip("low", "high")
    ends = parts.select("dim", "shard", F.posexplode(pairs).alias("c", "x")).groupBy("dim", "shard", "c").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    boxes: dict = {}
    for r in ends.groupBy("dim", "shard").agg(F.sort_array(F.collect_list(F.struct("c", "low", "high"))).alias("ends")).collect():
        boxes.setdefault(r.dim, []).append((r.shard, [x.low for x in r.ends], [x.high for x in r.ends]))
    boxes = {d: (np.array([s for s, _, _ in b], object), np.array([x for _, x, _ in b], float), np.array([x for _, _, x in b], float)) for d, b in boxes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, homes, least = batch.column(0).to_numpy(), np.asarray(batch.column(1).to_pylist(), object), batch.column(4).to_numpy()
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                if int(d) not in boxes:
                    continue
                names, low, high = boxes[int(d)]
                for at in range(0, len(mine), 1024):
                    rows = mine[at : at + 1024]
                    q = _matrix(batch.column(3).take(pa.array(rows)), len(rows))
                    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    # beyond 2**53 a bound is rounded: a little more is allowed then
                    i, j = np.nonzero((bounds + np.abs(bounds) * 1e-9 >= least[rows].astype(float)[:, None]) & (names[None, :] != homes[rows][:, None]))
                    if len(i):
                        part = batch.take(pa.array(rows[i]))
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[j].tolist(), pa.string()), part.column(2), part.column(3), part.column(4)], names=["dim", "shard", "id", "v", "least"])

    return queries.select("dim", "home", "id", "v", "least").mapInArrow(run, "dim int, shard string, id bigint, v array<double>, least bigint")
