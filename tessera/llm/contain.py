"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the number of their distinct word shingles, into powers of two. An item's sketch is its
smallest shingle hashes (bottom-k MinHash); k follows from the partition's largest size, so that a document with at
least the asked share of the item's shingles must hold a known number of the sketch: no such document is missed, however
long it is. Documents are probed with all their shingles in one pass; only ids of candidates go on, and the exact share
of the item's shingles is computed for those.

Everything is DataFrame functions. Sketches are broadcast if their counted rows are within a bound and joined by a
shuffle beyond it; the same holds for candidates.

Defined results: items without words match nothing; items of fewer words than a shingle count as one shingle, their
whole sequence, which only documents of just that sequence hold; rows that share a document or item id count as one
document or item; rows without an id and null texts match nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import SPACES, keep, lowered

#: Rows of a table that may be broadcast: ids and hashes of some tens of bytes each.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    trimmed = F.btrim(lowered(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed != "", F.split(trimmed, SPACES))


def _parts(words: Column, size: int) -> Column:
    """Arrays that hold, at one place, the words of one shingle; null without words."""
    count = F.size(words) - (size - 1)
    return F.when(count >= 1, F.arrays_zip(*[F.slice(words, k + 1, count).alias(f"w{k}") for k in range(size)]))


def hashed_shingles(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, hash of every shingle of every row; repeats included."""
    words = rows.select(key, F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    many = words.select(key, F.explode(_parts(F.col("w"), size)).alias("s")).select(key, F.xxhash64(*[F.col("s").getField(f"w{k}") for k in range(size)]).alias("hash"))
    few = words.where(F.size("w").between(1, size - 1)).select(key, F.xxhash64(F.col("w")).alias("hash"))
    return many.unionByName(few)


def text_shingles(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, shingle: distinct shingles as text."""
    words = rows.select(key, _words(F.col("text")).alias("w"))
    count = F.size("w") - (size - 1)
    parts = F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat_ws(" ", F.slice(F.col("w"), i, size)))).when(F.size("w") > 0, F.array(F.concat_ws(" ", "w")))
    return words.select(key, F.explode(F.array_distinct(parts)).alias("shingle")).distinct()


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= most else df


def sketches(items: DataFrame, size: int, percent: int, more: int = 3) -> DataFrame:
    """hash, item_id, need: the smallest hashes of each item and how many of them a match must hold at least."""
    distinct = keep(hashed_shingles(items, "item_id", size).distinct(), "item-shingles")
    sizes = distinct.groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    absent = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # of the item's size partition
    k = F.least(F.col("n"), F.floor(largest * (100 - percent) / F.lit(100)).cast("int") + 1 + more)
    ranked = distinct.join(sizes.select("item_id", k.alias("k"), (k - absent).alias("need")), "item_id").withColumn("at", F.row_number().over(W.partitionBy("item_id").orderBy("hash")))
    return keep(ranked.where("at <= k").select("hash", "item_id", "need"), "sketches")


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, shared, total, containment of every document that holds at least ``percent`` of an item's shingles."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    sketch = sketches(items, size, percent)
    hits = hashed_shingles(docs, "doc_id", size).join(bounded(sketch), "hash").groupBy("doc_id", "item_id", "need", "hash").agg(F.lit(1).alias("one"))
    candidates = keep(hits.groupBy("doc_id", "item_id", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("doc_id", "item_id"), "candidates")

    ids = bounded(keep(candidates.select("doc_id").distinct(), "candidate-ids"))
    exact = keep(text_shingles(items, "item_id", size), "item-texts")
    totals = exact.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    found = text_shingles(docs.join(ids, "doc_id", "left_semi"), "doc_id", size).join(bounded(exact), "shingle")
    shared = found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    verified = shared.join(totals, "item_id").join(candidates, ["doc_id", "item_id"], "left_semi").where(F.col("shared") * 100 >= F.col("total") * percent)
    return verified.select("doc_id", "item_id", "shared", "total", F.round(F.col("shared") / F.col("total"), 6).alias("containment"))
