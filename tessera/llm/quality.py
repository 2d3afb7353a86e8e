"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics come from one narrow pass over whole texts and are stored, a few bytes a document. Random Fourier features
approximate a Gaussian kernel over the standardised statistics; every partition of training rows adds up its share of
the normal equations, a fixed number of such sums meets on the driver. Rows that the equations have not seen calibrate.

All labelled training rows count; the isotonic fit takes at most ``calibration_rows`` of those set aside for it, in the
order of a hash of their id. Defined results: null and blank texts have all statistics zero; rows without an id are
scored and not held out; without training rows all scores are 0; an empty table gives none; repeated rows are kept.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import calibration
from tessera.llm.common import crc_remainder, keep

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "distinct_words", "top_word", "repeated_next", "once_words", "upper", "digits", "spaces",
    "newlines", "stops", "marks", "symbols", "pipes", "beyond_ascii", "distinct_lines", "line_words", "marked_ends", "short_words", "entropy",
)
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~_=+<>\\/{}[]"]] = True


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, n = len(data), len(words)
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    often = np.fromiter(counts.values(), float, len(counts)) / n
    lines = data.split(b"\n")
    ends = Counter(w[-1] for w in words)
    marked = sum(c for b, c in ends.items() if b < 128 and not (chr(b).isalnum() or chr(b) in ".,"))
    return [
        math.log1p(size), math.log1p(n), float(lengths.mean()), float(lengths.std()), len(counts) / n, float(often.max()), sum(map(operator.eq, words, words[1:])) / n,
        sum(c == 1 for c in counts.values()) / n, float(bytes_of[_UPPER].sum() / size), float(bytes_of[_DIGIT].sum() / size), float(bytes_of[32] / size),
        float(bytes_of[10] / size), float(bytes_of[46] / n), float((bytes_of[33] + bytes_of[63]) / n), float(bytes_of[_SYMBOL].sum() / n), float(bytes_of[124] / n),
        float(bytes_of[128:].sum() / size), len(set(lines)) / len(lines), math.log1p(n / len(lines)), marked / n, float((lengths <= 2).mean()),
        float(-(often * np.log(often)).sum() / math.log(n + 1)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, an array of single-precision statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float32).reshape(batch.num_rows, len(STATISTICS))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, x array<float>")


class Features:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, count: int = 256, width: float = 4.0, seed: int = 7):
        generator = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = generator.normal(size=(len(mean), count)) / width
        self.phases = generator.uniform(0, 2 * math.pi, count)

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([math.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def normal_equations(rows: DataFrame, features: Features, sums: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows (x, y) of outer products of features, and of features times labels."""
    size = len(features.phases) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = features.of(_matrix(batch.column(0)))
                gram += z.T @ z
                right += z.T @ batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "right_side": [right.tobytes()]})

    found = rows.select("x", "y").repartition(sums).mapInArrow(run, "gram binary, right_side binary").collect()
    gram = sum(np.frombuffer(r.gram).reshape(size, size) for r in found)
    return gram, sum(np.frombuffer(r.right_side) for r in found)


def fit(stored: DataFrame, labels: DataFrame, modulus: int = 3, ridge: float = 1e-3, calibration_rows: int = 20_000):
    """Features, weights and calibration from labelled rows whose crc32 remainder is not 1; None without any."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1)")
    marked = marked.where(crc_remainder(F.col("doc_id"), modulus) != 1).dropDuplicates(["doc_id"])
    rows = keep(stored.join(marked, "doc_id").select("doc_id", "x", "y", (F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0).alias("aside")), "training")
    used = rows.where("NOT aside")
    moments = used.select("y", *[F.col("x")[k].cast("double").alias(s) for k, s in enumerate(STATISTICS)])
    found = moments.agg(F.count(F.lit(1)), *[f(s) for s in STATISTICS for f in (F.avg, F.stddev_pop)]).first()
    if not found[0]:
        return None
    features = Features(np.array(found[1::2], float), np.array(found[2::2], float))
    gram, right = normal_equations(used, features)
    weights = np.linalg.solve(gram + ridge * found[0] * np.eye(len(gram)), right)
    aside = rows.where("aside").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows).select("x", "y").toPandas()
    if not len(aside):
        aside = used.orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows).select("x", "y").toPandas()
    raw = features.of(np.array(aside["x"].tolist(), float).reshape(len(aside), -1)) @ weights
    return features, weights, calibration.isotonic(raw, aside["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stored = keep(document_statistics(docs), "statistics")
    model = fit(stored, labels, modulus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                found = np.zeros(batch.num_rows)
            else:
                features, weights, knots = model
                found = calibration.apply(knots, features.of(_matrix(batch.column(1))) @ weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    scored = stored.mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
