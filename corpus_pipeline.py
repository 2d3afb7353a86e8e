"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import contain, packing, passages, simhash, toxicity
from tessera.llm.catalogue import tokenizer_path
from tessera.llm.common import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below one half; scores are joined back by id where rejected, within a checked bound."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    rejected = keep(scored.where("predicted = 1").select("doc_id").distinct(), "toxic-ids")
    return docs.join(contain.bounded(rejected), "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; of rows that share that id, one; all rows without an id."""
    found = keep(simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "duplicate-ids")
    left = docs.join(contain.bounded(found), "doc_id", "left_anti").select(*docs.columns)
    repeated = keep(left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if not repeated.take(1):
        return left
    ids = contain.bounded(repeated)
    return left.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_passages(docs, keep(passages.repeated_passages(docs), "passages"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = keep(contain.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leak-ids")
    return docs.join(contain.bounded(found), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("packing", pack),
]

#: Compression distances, alignments and tokenizing are beyond SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory; each stage's rows are stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
