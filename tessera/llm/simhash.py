"""SimHash near-duplicates with pivot distance tables.

Fingerprints come from one narrow pass. Equal fingerprints are one class; all further work is on distinct fingerprints.
The pivot table holds every fingerprint's Hamming distances to 32 fixed reference fingerprints, 8 for each quarter of
the bits, that is, distances within that quarter. Two fingerprints at most two bits apart differ in at most two
quarters, so their distances agree exactly on the references of at least two others: the six pairs of quarters give six
keys, and candidates are pairs that share one. A candidate is discarded if its distances to any reference differ by
more than two (the triangle inequality), and survivors are verified bit by bit.

A key that more than ``most`` fingerprints share is not expanded into pairs. There, every fingerprint emits itself and
its 32 neighbours at one bit in the other two quarters; two fingerprints at most two bits apart that agree on the key's
quarters meet in one of these points, at which at most 33 fingerprints can meet. So no link is lost and no group grows.

Defined results: null and blank texts have fingerprint zero and are linked like others; repeated rows are kept; rows
without an id keep their fingerprint, have no component and link nothing; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, plain_words, worker_cache
from tessera.llm.components import components

SEED = 42
LANES = np.uint64(0x0101010101010101)


def _references(count: int = 8, seed: int = 20240229) -> list[list[int]]:
    """Patterns of 16 bits for each quarter: the unit steps of a generator that any language can repeat."""
    state, found = seed, []
    for quarter in range(4):
        found.append([])
        for _ in range(count):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            found[-1].append((state >> 33) % 2**16)
    return found


REFERENCES = _references()


def fingerprint(words: list[bytes], size: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included; zero without words."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(text, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, (text[a:b] for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())), repeat(SEED)), np.uint64, len(words) - size + 1)
    # sums of single bits in eight byte lanes at once; 255 rows cannot overflow a byte
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[: len(hashes)] = hashes
    padded, bits = padded.reshape(-1, 255), 0
    for k in range(8):
        lanes = ((padded >> np.uint64(k)) & LANES).sum(axis=1, dtype=np.uint64)
        for lane, count in enumerate(lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64).tolist()):
            if 2 * count > len(hashes):
                bits |= 1 << (8 * lane + k)
    return bits


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, as a signed 64-bit integer, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None, 0)  # what an earlier stage of a pipeline has left
        for batch in batches:
            found = np.fromiter((fingerprint(plain_words(t.as_py())) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _quarter_distances(fp: Column, quarter: int) -> Column:
    """Distances to the quarter's references, five bits each, in one integer."""
    bits = F.shiftrightunsigned(fp, 16 * quarter).bitwiseAND(F.lit(0xFFFF))
    parts = [F.shiftleft(F.bit_count(bits.bitwiseXOR(F.lit(r))).cast("bigint"), 5 * k) for k, r in enumerate(REFERENCES[quarter])]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _differ_by_more(a: Column, b: Column, most: int) -> Column:
    """Whether two packed distance vectors differ by more than ``most`` in some coordinate."""
    fields = [F.abs(F.shiftright(a, 5 * k).bitwiseAND(F.lit(31)) - F.shiftright(b, 5 * k).bitwiseAND(F.lit(31))) for k in range(len(REFERENCES[0]))]
    return F.greatest(*fields) > most


def links(classes: DataFrame, bits: int = 2, most: int = 64) -> DataFrame:
    """Pairs u, v of ids of classes (fp, id) whose fingerprints differ in at most two bits; not every pair of a group
    that shares a hot key, but enough to connect it."""
    if bits != 2:
        raise ValueError("the keys are made for two bits")
    pivots = classes.select("fp", "id", *[_quarter_distances(F.col("fp"), q).alias(f"d{q}") for q in range(4)])
    keys = [F.struct(F.lit(n).alias("pair"), F.col(f"d{a}").alias("a"), F.col(f"d{b}").alias("b")) for n, (a, b) in enumerate(combinations(range(4), 2))]
    keyed = pivots.select("fp", "id", "d0", "d1", "d2", "d3", F.explode(F.array(*keys)).alias("k")).select("fp", "id", "d0", "d1", "d2", "d3", "k.pair", "k.a", "k.b")
    sizes = keep(keyed.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key-sizes")
    shared = keep(keyed.join(sizes, ["pair", "a", "b"]), "shared-keys")

    few = shared.where(F.col("n") <= most)
    left, right = few.alias("l"), few.select("pair", "a", "b", *[F.col(c).alias(f"{c}_r") for c in ("fp", "id", "d0", "d1", "d2", "d3")])
    pairs = left.join(right, ["pair", "a", "b"]).where("fp < fp_r")
    for q in range(4):
        pairs = pairs.where(~_differ_by_more(F.col(f"d{q}"), F.col(f"d{q}_r"), bits))
    direct = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_r"))) <= bits).select(F.col("id").alias("u"), F.col("id_r").alias("v"))

    def flips(pair: tuple[int, int]) -> Column:
        free = [16 * q + k for q in range(4) if q not in pair for k in range(16)]
        masks = [0] + [(1 << f) - (1 << 64 if f == 63 else 0) for f in free]
        return F.array(*[F.lit(m).cast("bigint") for m in masks])

    masks = reduce(lambda c, n: c.when(F.col("pair") == n[0], flips(n[1])), list(enumerate(combinations(range(4), 2)))[1:], F.when(F.col("pair") == 0, flips((0, 1))))
    points = shared.where(F.col("n") > most).select("id", "fp", "pair", F.explode(masks).alias("mask")).select("id", "pair", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    met = points.groupBy("pair", "point").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    through = met.select(F.array_min("ids").alias("u"), F.explode("ids").alias("v")).where("u <> v")
    return direct.unionByName(through)


def near_duplicates(docs: DataFrame, bits: int = 2, most: int = 64) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest id reachable) of every row."""
    prints = keep(fingerprints(docs), "fingerprints")
    classes = keep(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    found = components(keep(links(classes, bits, most), "links"))
    # one stored row per fingerprint, so that the last join's two sides are plain exchanges, which AQE can split
    labels = keep(classes.join(found, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "id").alias("component_id")), "labels")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    joined = prints.join(labels, F.col("fp") == F.col("_fp"), "left")
    return joined.select("doc_id", text.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
